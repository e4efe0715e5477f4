"""Errors raised while a plan is being composed, before any job runs."""


class PlanError(ValueError):
    """A step cannot be composed: bad configuration, unknown column, bad binding."""


class UnknownColumnError(PlanError):
    def __init__(self, name, available):
        super().__init__(f"no column named {name!r}; the input has {list(available)}")
        self.name = name


class RequiredParamError(PlanError):
    def __init__(self, param):
        super().__init__(f"parameter {param!r} has neither a bound value nor a default")
        self.param = param


class UnboundColumnError(PlanError):
    def __init__(self, param):
        super().__init__(f"column parameter {param!r} is not bound to any column")
        self.param = param


class MixedShapeError(PlanError):
    """Whole-column and per-row parameters are bound to columns in one function."""


class BundleLengthError(PlanError):
    """Varying parameters are bound to different numbers of columns."""


class TransformedCycleError(PlanError):
    """Tables read each other's transformed output in a circle."""

    def __init__(self, path):
        self.path = list(path)
        super().__init__("transformed tables form a cycle: " + " -> ".join(self.path))


class StorageError(RuntimeError):
    """A table or snapshot version could not be read or published."""
