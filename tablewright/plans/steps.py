"""Steps of a table's pipeline, their order, and the choice a run type makes among them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from tablewright.errors import PlanError
from tablewright.functions.binding import Columns, require_columns, resolve_calls
from tablewright.functions.user import UserFunction
from tablewright.naming import normalize_label
from tablewright.operators.columns import Rename, append_columns, broadcast_scalar, replace_columns
from tablewright.operators.filters import DateRange, Filter
from tablewright.operators.joins import Join
from tablewright.operators.pivot import Pivot

BUILTINS = (Filter, DateRange, Rename, Join, Pivot)

# What a run executes.
RUN_TYPES = ("transforms", "validations", "set", "all")
OUTPUT_MODES = ("append", "replace")


class FunctionFailure(PlanError):
    """One function fails; the other functions of the step go on."""


@dataclass(frozen=True)
class FunctionStep:
    """A user function with its parameters bound to columns (``cols(...)``) or values.

    ``append`` adds one column per bundle, ``replace`` overwrites the i-th target with bundle i,
    or the input column when there is only one.
    """

    function: UserFunction
    bind: Mapping[str, object] = field(default_factory=dict)
    output: str = "append"
    append_name: str | None = None
    targets: Sequence[str] = ()

    kind = "function"
    tail_rank = 0

    def __post_init__(self):
        if self.output not in OUTPUT_MODES:
            raise PlanError(f"output is one of {OUTPUT_MODES}")

    @property
    def keeps_rows(self) -> bool:
        return self.function.shape != "table"

    def calls(self):
        return resolve_calls(self.function.params, self.function.defaults, self.bind)

    def first_column(self) -> str:
        bound = (self.bind.get(name) for name in self.function.params)
        return next((c.names[0] for c in bound if isinstance(c, Columns) and c.names), "")

    def transform(self, df: DataFrame, raw: DataFrame, tables=None) -> tuple[DataFrame, list[str]]:
        """The new working frame and the keys of the bundles that made it.

        Raises FunctionFailure for a bad binding, and any other PlanError for a failed step.
        """
        fn = self.function
        try:
            calls = self.calls()
        except PlanError as cause:
            raise FunctionFailure(str(cause)) from cause
        require_columns(fn.params, self.bind)

        if fn.shape == "table":
            for call in calls:
                source = raw if getattr(fn, "reads_raw", False) else df
                df = fn.table(source, call, tables)
            return df, [call.key for call in calls]
        if fn.shape == "value":
            name = self.append_name or normalize_label(fn.name)
            return broadcast_scalar(df, name, fn.expression(df, calls[0])), [""]

        placed: list[tuple[str, Column]] = [
            (target, fn.expression(df, call)) for target, call in zip(self._targets(calls), calls, strict=True)
        ]
        place = replace_columns if self._replaces(calls) else append_columns
        return place(df, placed), [call.key for call in calls]

    def _replaces(self, calls) -> bool:
        """Without an input column there is nothing to overwrite by default."""
        return self.output == "replace" and bool(calls[0].columns or self.targets)

    def _targets(self, calls) -> list[str]:
        fn = self.function
        if not self._replaces(calls):
            return [self.append_name or normalize_label(f"{fn.name}_{c.key}") for c in calls]
        several = len(calls[0].columns) >= 2
        if several and not self.targets:
            raise FunctionFailure(f"{fn.name!r} reads several columns; name a target column for each bundle")
        targets = list(self.targets[: len(calls)])
        if several and len(targets) < len(calls):
            raise PlanError(f"{fn.name!r} has {len(calls)} bundles but {len(targets)} targets")
        return targets + [c.key for c in calls[len(targets) :]]


@dataclass(frozen=True)
class FunctionSet:
    """A named list of function steps that behaves like its members placed one by one."""

    name: str
    members: tuple[FunctionStep, ...]

    kind = "set"
    tail_rank = 0

    def __post_init__(self):
        object.__setattr__(self, "members", tuple(self.members))


Step = FunctionStep | FunctionSet | Filter | DateRange | Rename | Join | Pivot


def is_builtin(step) -> bool:
    return isinstance(step, BUILTINS)


def members_of(step) -> tuple[FunctionStep, ...]:
    if isinstance(step, FunctionSet):
        return step.members
    return (step,) if isinstance(step, FunctionStep) else ()


def has_kind(step, kind: str) -> bool:
    return any(member.function.kind == kind for member in members_of(step))


def check_steps(steps: Sequence[Step]) -> None:
    """A table has at most one date range and one rename: both act on its final output."""
    for builtin in (DateRange, Rename):
        if sum(isinstance(step, builtin) for step in steps) > 1:
            raise PlanError(f"a table has at most one {builtin.kind} step")


# Run type -> kinds of functions it runs, and whether built-in steps run too. A run of one set is apart.
_RUNS = {
    "all": ({"transform", "validation"}, True),
    "transforms": ({"transform"}, True),
    "validations": ({"validation"}, False),
    "set": ({"transform", "validation"}, False),
}


def select_steps(steps: Sequence[Step], run_type: str, set_name: str | None = None) -> list[tuple[int, Step]]:
    """(position, step) pairs a run executes, in order: the list order, then date range and rename at the end.
    An unknown run type executes nothing."""
    check_steps(steps)
    kinds, builtins = _RUNS.get(run_type, (set(), False))

    def takes(step: Step) -> bool:
        if is_builtin(step):
            return builtins
        named = run_type != "set" or (isinstance(step, FunctionSet) and step.name == set_name)
        return named and (run_type in ("all", "set") or any(has_kind(step, kind) for kind in kinds))

    chosen = [(position, step) for position, step in enumerate(steps) if takes(step)]
    return sorted(chosen, key=lambda pair: (pair[1].tail_rank, pair[0])) if kinds else []


def wants(run_type: str, kind: str) -> bool:
    return kind in _RUNS.get(run_type, (set(), False))[0]


def bundle_label(key: str, function_name: str) -> str:
    return normalize_label(key or function_name)
