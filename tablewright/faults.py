"""Which run-time errors a step's own expressions can raise, and which come from the machinery under it."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException

from tablewright.errors import PlanError

# An error that names its condition: bad values (22), wrong cardinality (21), raised errors (P0), plans that
# cannot work (42, 0A), but not a missing path (42K03). Its message may quote any value of the data, and what
# follows quotes the query up to the stack.
_OWN = re.compile(
    r"\[[A-Z][A-Z0-9_.]+\](?:(?!SQLSTATE: ).)*SQLSTATE: (?!42K03)(?:22|21|P0|42|0A)\w*(?:\s*\n== (?:(?!\n\tat |JVM stacktrace).)*)?",
    re.DOTALL,
)
# How a user function's exception arrives, see ``raised_by``.
_RAISED = "user function raised"
_FUNCTION = re.compile(rf"^(?:.*: )?RuntimeError: {_RAISED} ", re.MULTILINE)
_PYTHON = re.compile(r"PythonException|An exception was thrown from the Python worker")
_MACHINERY = re.compile(
    r"No space left|OutOfMemoryError|\bMemoryError\b|\bOSError\b|\bIOError\b|PermissionError|ConnectionError|"
    r"FetchFailed|ExecutorLostFailure|Python worker exited unexpectedly|FileNotFound|FILE_NOT_EXIST"
)


def raised_by(name: str, cause: Exception) -> RuntimeError:
    """The error to raise in place of what a user function raised. Whatever its type and words, it is the
    function's fault."""
    return RuntimeError(f"{_RAISED} {type(cause).__name__} in {name!r}: {cause}")


def is_step_fault(cause: BaseException) -> bool:
    """Whether the data or a function is to blame. A full disk, a lost file or a lost race is not a step's
    fault, and an error that cannot be placed isn't either. Words that a message quotes from the data or from
    a function's own exception decide nothing."""
    if isinstance(cause, PlanError):
        return True
    if not isinstance(cause, PySparkException):
        return False
    text = str(cause)
    if _FUNCTION.search(text):
        return True
    rest = _OWN.sub("", text)
    if _MACHINERY.search(rest):
        return False
    return rest != text or bool(_PYTHON.search(rest))


class Interrupted(Exception):
    """A frame could not be materialized; ``cause`` says why."""

    def __init__(self, cause: BaseException):
        super().__init__(str(cause))
        self.cause = cause
