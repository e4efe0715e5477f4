"""Running a table's steps: one lazy plan, its results, and the write that executes it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import PlanError, StorageError, TransformedCycleError
from tablewright.faults import Interrupted, is_step_fault
from tablewright.functions.binding import Call, require_columns
from tablewright.naming import normalize_label, short_id
from tablewright.operators.filters import DateRange, Filter
from tablewright.operators.joins import Join
from tablewright.plans import verdicts as V
from tablewright.plans.steps import (
    FunctionFailure,
    FunctionStep,
    bundle_label,
    is_builtin,
    members_of,
    select_steps,
    wants,
)
from tablewright.plans.workspace import Workspace
from tablewright.session import checkpoint_dir
from tablewright.sources.folder import Folder
from tablewright.sources.versions import Version
from tablewright.types import describe

# The fields of a run result.
RESULT_SCHEMA = (
    "step_no int, source_name string, function_name string, function_type string, set_name string, "
    "bundle_key string, label string, status string, rows_affected long, rows_passed long, "
    "rows_failed long, pass_rate double, error string, result_id string, consumed_result_id string"
)
_TYPES = dict(item.split(" ") for item in RESULT_SCHEMA.split(", "))


@dataclass(frozen=True)
class Rows:
    """A number of rows: all of a frame, or those that pass the filters right behind it.

    Counting such filters on the frame before them lets one pass answer several steps.
    """

    frame: DataFrame
    within: Column | None = None

    def count(self) -> Column:
        return F.count(F.lit(1)) if self.within is None else F.count_if(self.within)

    def behind(self, predicate: Column) -> Rows:
        return Rows(self.frame, predicate if self.within is None else self.within & predicate)


@dataclass(frozen=True)
class Entry:
    """Outcome of one function with one bundle, or of one built-in step."""

    step_no: int
    source_name: str
    function_name: str
    function_type: str
    bundle_key: str = ""
    set_name: str | None = None
    label: str = ""
    error: str | None = None
    consumed_result_id: str | None = None
    # Where `rows_affected` or the verdict counts come from.
    counted: Rows | None = field(default=None, compare=False)
    # The number itself, once it is known.
    n_rows: int | None = None
    check: V.Check | None = None

    @property
    def status(self) -> str:
        return "ok" if self.error is None else "failed"

    @property
    def result_id(self) -> str:
        return short_id(self.function_name, self.bundle_key, self.source_name)

    def as_struct(self, **counts):
        """The entry as literals, with aggregate Columns for its counts."""
        values = {
            "step_no": self.step_no,
            "source_name": self.source_name,
            "function_name": self.function_name,
            "function_type": self.function_type,
            "set_name": self.set_name,
            "bundle_key": self.bundle_key,
            "label": self.label,
            "status": self.status,
            "error": self.error,
            "result_id": self.result_id,
            "consumed_result_id": self.consumed_result_id,
        }
        if "rows_passed" in counts:
            counts["pass_rate"] = V.pass_rate(counts["rows_passed"], counts["rows_failed"])
        return F.struct(
            *[counts.get(n, F.lit(values.get(n))).cast(t).alias(n) for n, t in _TYPES.items()]
        )


@dataclass(frozen=True)
class Composed:
    """A run that has been planned and not executed."""

    workspace: Workspace
    table: str
    run_type: str
    set_name: str | None
    base: DataFrame
    frame: DataFrame
    entries: tuple[Entry, ...]

    @property
    def transforms(self) -> bool:
        """Whether the run replaces the table's transformed output."""
        return any(e.function_type == "transform" for e in self.entries)

    def _write(self) -> Version | None:
        """Publish the frame, unless every transform failed: then there is no transformed output."""
        if self.final_rows is None:
            self.workspace.store.drop_snapshots(self.table)
            return None
        return self.workspace.store.write_snapshot(self.table, self.frame)

    @property
    def checks(self) -> list[V.Check]:
        return [e.check for e in self.entries if e.check is not None]

    def results(self) -> DataFrame:
        """One row per entry, in step order, in one job.

        All validations share one aggregate over the base table. Row counts of transforms come
        from one pass per join, pivot, table function or first filter, which also counts the
        filters right behind it and reads only the columns that takes. Counts are aggregates rather than observed
        metrics because a task that is run again would be counted twice.
        """
        parts = []
        plain = [e for e in self.entries if e.check is None and e.counted is None]
        if plain:
            parts.append(_literal_rows(self.base, plain))
        frames: dict[int, tuple[DataFrame, list[Entry]]] = {}
        for e in self.entries:
            if e.counted is not None:
                frames.setdefault(id(e.counted.frame), (e.counted.frame, []))[1].append(e)
        for frame, entries in frames.values():
            parts.append(_exploded(frame, [e.as_struct(rows_affected=e.counted.count()) for e in entries]))
        checked = [e for e in self.entries if e.check is not None]
        if checked:
            counts = V.count_columns(self.base, self.checks)
            structs = [
                e.as_struct(rows_passed=good, rows_failed=bad)
                for e, (good, bad) in zip(checked, counts, strict=True)
            ]
            parts.append(_exploded(V.with_verdicts(self.base, self.checks), structs))
        if not parts:
            return self.workspace.spark.createDataFrame([], RESULT_SCHEMA)
        return reduce(DataFrame.unionByName, parts).orderBy("step_no")

    def failing_rows(self, key: str) -> DataFrame:
        """``result_id, key, row_json`` of all rows that failed a validation of this run."""
        return V.all_failing_rows(self.base, self.checks, key)

    def failing(self, result_id: str) -> DataFrame:
        """The full rows behind one failed validation."""
        for check in self.checks:
            if check.result_id == result_id:
                return V.failing_rows(self.base, check)
        raise PlanError(f"no validation of this run has the id {result_id!r}")

    def execute(self, count_steps: bool = True) -> Executed:
        """Write the snapshot and compute the results.

        With ``count_steps``, a join, pivot or table function that others follow writes its frame once
        below the checkpoint folder; the next one and the counts read that, so no step runs twice.
        Without, only the rows behind the last row-changing step are counted, from the snapshot.

        A failure that the data or a function causes surfaces only now. The steps are then run again one by
        one, each written; a step that fails is recorded and left out, and validations are counted one by
        one. Any other failure, such as a full disk, is raised, and nothing is published.
        """
        store = self.workspace.store
        scratch = _Scratch(self.workspace)
        run, version = self, None
        try:
            if store is not None and self.transforms:
                try:
                    run = run._composed(scratch, wide=True) if count_steps and run._wide_steps() > 1 else run
                    version = run._write()
                except Exception as failure:  # noqa: BLE001 - raised again unless a step is at fault
                    _raise_unless_step_fault(failure)
                    run = self._composed(scratch)
                    version = run._write()
                if version is not None:
                    run = run._counting(store.snapshots(self.table).read(version), count_steps)
            try:
                rows = run.results().collect()
            except Exception as failure:  # noqa: BLE001 - raised again unless a verdict or step is at fault
                _raise_unless_step_fault(failure)
                run = run._isolated_checks() if store is not None else run._composed(scratch)._isolated_checks()
                rows = run.results().collect()
        finally:
            # Without a snapshot the run's frame is read from there.
            if version is not None or store is not None:
                scratch.drop()
        # One row per entry: the report of a run is as small as its list of steps.
        results = self.workspace.spark.createDataFrame(rows, RESULT_SCHEMA)
        counts = {row["step_no"]: row["rows_affected"] for row in rows}
        known = tuple(e if e.check else replace(e, counted=None, n_rows=counts.get(e.step_no)) for e in run.entries)
        return Executed(replace(run, entries=known), results, version.number if version else None)

    def _wide_steps(self) -> int:
        """Frames that are counted apart."""
        return len({id(e.counted.frame) for e in self.entries if e.counted is not None})

    def _composed(self, scratch: _Scratch, wide: bool = False) -> Composed:
        """The same run with frames written on the way: after every step, or (``wide``) where a join, pivot
        or table function has more row-changing steps behind it."""
        settle = _Settle(scratch.write, self._wide_steps() - 1 if wide else None)
        try:
            return compose(self.workspace, self.table, self.run_type, self.set_name, settle=settle)
        except Interrupted as failure:
            raise failure.cause from None

    @property
    def final_rows(self) -> Rows | None:
        """The rows behind the last step that could change their number; None without such rows."""
        counted = [e.counted for e in self.entries if e.counted is not None]
        return counted[-1] if counted else None

    def _counting(self, written: DataFrame, count_steps: bool) -> Composed:
        """Let the snapshot's footers answer the count of every step after the last row change, and read the
        frame from it. Without ``count_steps`` the others are not counted."""
        last, now = self.final_rows, Rows(written)
        entries = [replace(e, counted=now) if e.counted is not None and e.counted is last else e for e in self.entries]
        if not count_steps:
            entries = [e if e.counted is now else replace(e, counted=None) for e in entries]
        return replace(self, frame=written, entries=tuple(entries))

    def _isolated_checks(self) -> Composed:
        entries = []
        for e in self.entries:
            if e.check is not None:
                try:
                    V.verdict_counts(self.base, [e.check]).collect()
                except Exception as cause:  # noqa: BLE001 - recorded on the entry if it is at fault
                    _raise_unless_step_fault(cause)
                    e = replace(e, error=str(cause), check=None)
            entries.append(e)
        return replace(self, entries=tuple(entries))


def _raise_unless_step_fault(failure: Exception) -> None:
    if not is_step_fault(failure):
        raise failure


class _Scratch:
    """Frames a run writes on its way, below the checkpoint folder or, where none is named, the store."""

    def __init__(self, workspace: Workspace):
        self.workspace, self.folder = workspace, None

    def write(self, frame: DataFrame) -> DataFrame:
        if self.folder is None:
            base = checkpoint_dir(self.workspace.spark)
            if base is None and self.workspace.store is None:
                raise StorageError("set spark.checkpoint.dir to a folder all executors can reach")
            base = base or self.workspace.store.root.path
            self.folder = Folder(self.workspace.spark, f"{base.rstrip('/')}/runs/{uuid.uuid4().hex}")
        path = self.folder.url(uuid.uuid4().hex)
        frame.write.parquet(path)
        return self.workspace.spark.read.schema(frame.schema).parquet(path)

    def drop(self) -> None:
        if self.folder is not None:
            self.folder.delete(".")


class _Settle:
    """Writes the frame behind a step. With ``wide``, only the first so many that change rows in bulk."""

    def __init__(self, write: Callable[[DataFrame], DataFrame], wide: int | None):
        self.write, self.wide, self.left = write, wide is not None, wide

    def __call__(self, frame: DataFrame, bulk: bool) -> DataFrame:
        if self.wide:
            if not bulk or not self.left:
                return frame
            self.left -= 1
        try:
            return self.write(frame)
        except Exception as cause:
            # Which step a wide write fails for is not known; the caller runs them one by one.
            if self.wide or not is_step_fault(cause):
                raise Interrupted(cause) from cause
            raise


@dataclass(frozen=True)
class Executed:
    """A finished run: what ran, its results, and the snapshot version it published."""

    run: Composed
    results: DataFrame
    version: int | None


def _exploded(df: DataFrame, structs) -> DataFrame:
    return df.agg(F.array(*structs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def _literal_rows(df: DataFrame, entries: list[Entry]) -> DataFrame:
    rows = [
        (e.step_no, e.source_name, e.function_name, e.function_type, e.set_name, e.bundle_key, e.label, e.status)
        + (e.n_rows, None, None, None, e.error, e.result_id, e.consumed_result_id)
        for e in entries
    ]
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)


def compose(
    workspace: Workspace,
    table: str,
    run_type: str = "all",
    set_name: str | None = None,
    *,
    path: tuple[str, ...] | None = None,
    settle: Callable[[DataFrame, bool], DataFrame] | None = None,
    before: int | None = None,
) -> Composed:
    """Plan a run. Transforms and built-in steps chain on the working frame, validations read the
    raw table. A step that cannot be planned is recorded as failed and the chain goes on from the
    last good frame. ``settle`` materializes the frame after each step; ``before`` leaves out the
    step at that position of the list and all behind it."""
    base = workspace.raw(table)
    fold = _Fold(workspace, table, base, path or (table,), settle)
    for position, step in select_steps(workspace.steps(table), run_type, set_name):
        if before is not None and position >= before:
            continue
        if is_builtin(step):
            fold.builtin(position, step)
        else:
            for member in members_of(step):
                owner = getattr(step, "name", None)
                if member.function.kind == "transform" and wants(run_type, "transform"):
                    fold.transform(member, owner)
                if member.function.kind == "validation" and wants(run_type, "validation"):
                    fold.validation(member, owner)
    return Composed(workspace, table, run_type, set_name, base, fold.frame, tuple(fold.entries))


def effective_columns(workspace: Workspace, table: str, position: int) -> list[tuple[str, str]]:
    """Columns the step at a position can bind, with their types: those of the table, and what
    earlier steps added, such as the columns of joined tables. No row is computed, but the values of a
    pivot that doesn't list them are looked up."""
    return describe(compose(workspace, table, "transforms", before=position).frame.schema)


class _Fold:
    def __init__(self, workspace, table, base, path, settle):
        self.table, self.base, self.frame = table, base, base
        self.tables = workspace.view(*path)
        self.nested = len(path) > 1
        self.settle = settle or (lambda frame, bulk: frame)
        # The current number of rows, whether a step has reported it, and whether the columns are
        # still those of the counted frame.
        self.rows, self.reported, self.same_columns = Rows(base), False, True
        self.entries: list[Entry] = []

    def _add(self, name, kind, key, **more):
        label = more.pop("label", bundle_label(key, name))
        self.entries.append(Entry(len(self.entries), self.table, name, kind, key, label=label, **more))

    def _advance(self, frame: DataFrame, keeps_rows: bool, predicate: Column | None = None) -> None:
        settled = self.settle(frame, not keeps_rows and predicate is None)
        if settled is not frame or not keeps_rows:
            if settled is frame and predicate is not None and self.same_columns and self.reported:
                self.rows = self.rows.behind(predicate)
            else:
                self.rows, self.same_columns = Rows(settled), True
            self.reported = False
        else:
            self.same_columns = False
        self.frame = settled

    def _rows(self) -> Rows:
        self.reported = True
        return self.rows

    def builtin(self, position: int, step) -> None:
        more = {"label": normalize_label(step.kind), "set_name": step.kind}
        key = f"{step.kind}:{position}"
        try:
            consumed = predicate = None
            if isinstance(step, Join):
                frame, consumed = step.apply_with_lineage(self.frame, self.tables)
            elif isinstance(step, Filter | DateRange):
                predicate = step.predicate(self.frame)
                frame = self.frame.filter(predicate)
            else:
                frame = step.apply(self.frame, self.tables)
            self._advance(frame, step.keeps_rows, predicate)
        except Interrupted:
            raise
        except Exception as cause:  # noqa: BLE001 - recorded on the entry, the chain goes on
            if self.nested and isinstance(cause, TransformedCycleError):
                raise
            self._add(step.kind, "transform", key, error=str(cause), **more)
        else:
            self._add(step.kind, "transform", key, counted=self._rows(), consumed_result_id=consumed, **more)

    def transform(self, member: FunctionStep, owner: str | None) -> None:
        name = member.function.name
        try:
            frame, keys = member.transform(self.frame, self.base, self.tables)
            self._advance(frame, member.keeps_rows)
        except Interrupted:
            raise
        except FunctionFailure as cause:
            self._add(name, "transform", "", set_name=owner, error=str(cause), counted=self._rows())
        except Exception as cause:  # noqa: BLE001 - recorded on the entry, the chain goes on
            self._add(name, "transform", member.first_column(), set_name=owner, error=str(cause))
        else:
            for key in keys:
                self._add(name, "transform", key, set_name=owner, counted=self._rows())

    def validation(self, member: FunctionStep, owner: str | None) -> None:
        fn = member.function
        try:
            calls = checked_calls(member)
        except PlanError as cause:
            self._add(fn.name, "validation", "", set_name=owner, error=str(cause))
            return
        for call in calls:
            check = V.Check(short_id(fn.name, call.key, self.table), fn, call)
            try:
                V.verify(self.base, check)
            except Exception as cause:  # noqa: BLE001 - recorded on the entry, the others go on
                self._add(fn.name, "validation", call.key, set_name=owner, error=str(cause))
            else:
                self._add(fn.name, "validation", call.key, set_name=owner, check=check)


def checked_calls(member: FunctionStep) -> list[Call]:
    """A validation's calls; an unbound column parameter fails the function."""
    calls = member.calls()
    require_columns(member.function.params, member.bind)
    return calls
