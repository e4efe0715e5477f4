"""The tables of a session with their steps, and where a step's other input comes from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tablewright.errors import PlanError, TransformedCycleError
from tablewright.naming import transformed_id
from tablewright.plans.steps import FunctionSet, Step, check_steps, has_kind, is_builtin, members_of
from tablewright.sources.store import TableStore


class Workspace:
    """Tables by name: frames given directly, or stored tables of a :class:`TableStore`."""

    def __init__(self, spark: SparkSession, store: TableStore | None = None):
        self.spark = spark
        self.store = store
        self._frames: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        self._steps: dict[str, tuple[Step, ...]] = {}

    def add(self, name: str, frame: DataFrame | Callable[[], DataFrame] | None = None, steps: Sequence[Step] = ()):
        """Declare a table. Without a frame its rows come from the store."""
        check_steps(steps)
        if frame is not None:
            self._frames[name] = frame
        self._steps[name] = tuple(steps)
        return self

    def has_frame(self, name: str) -> bool:
        return name in self._frames

    def names(self) -> list[str]:
        stored = self.store.names() if self.store else []
        return sorted({*self._frames, *self._steps, *stored})

    def steps(self, name: str) -> tuple[Step, ...]:
        return self._steps.get(name, ())

    def raw(self, name: str) -> DataFrame:
        """The stored rows of a table, before any step."""
        frame = self._frames.get(name)
        if frame is not None:
            return frame() if callable(frame) else frame
        if self.store is None or name not in self.store.names():
            raise PlanError(f"no table named {name!r}")
        return self.store.read(name)

    def view(self, *path: str) -> TableView:
        return TableView(self, path)

    def resolve(self, name: str, mode: str = "raw") -> tuple[DataFrame, str | None]:
        return self.view().resolve(name, mode)

    def tables_with_function(self, function: str) -> list[str]:
        """Tables one of whose steps or sets contains the function, by name."""
        return [
            table
            for table in self.names()
            if any(m.function.name == function for step in self.steps(table) for m in members_of(step))
        ]

    def tables_with_set(self, set_name: str) -> list[str]:
        return [
            table
            for table in self.names()
            if any(isinstance(s, FunctionSet) and s.name == set_name for s in self.steps(table))
        ]


class TableView:
    """Resolves tables for one run and remembers which transformed outputs it is composing."""

    def __init__(self, workspace: Workspace, path: tuple[str, ...]):
        self.workspace = workspace
        self.path = path

    def raw(self, name: str) -> DataFrame:
        return self.workspace.raw(name)

    def unique_key(self, name: str) -> str | None:
        """The key of a stored table, which no two of its rows share; None for a frame."""
        store = self.workspace.store
        if store is None or self.workspace.has_frame(name) or name not in store.names():
            return None
        return store.spec(name).key

    def resolve(self, name: str, mode: str = "raw") -> tuple[DataFrame, str | None]:
        """The table and, for a transformed one, the identity of the output that is read.

        The latest snapshot is used as it is. Without one the table's own steps are composed into
        the caller's plan; a table without transform steps is its own transformed output.
        """
        if mode == "raw":
            return self.raw(name), None
        if mode != "transformed":
            raise PlanError(f"a table is read 'raw' or 'transformed', not {mode!r}")
        if name in self.path:
            raise TransformedCycleError([*self.path[self.path.index(name) :], name])
        store = self.workspace.store
        snapshots = store.snapshots(name) if store else None
        latest = snapshots.latest() if snapshots else None
        if latest is not None:
            return snapshots.read(latest), transformed_id(name, latest.number)

        from tablewright.plans.run import compose

        transforms = [s for s in self.workspace.steps(name) if is_builtin(s) or has_kind(s, "transform")]
        if not transforms:
            return self.raw(name), transformed_id(name, 0)
        composed = compose(self.workspace, name, "transforms", path=(*self.path, name))
        return composed.frame, transformed_id(name, 0)
