"""Binding of function parameters to columns and values, resolved before any job runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from tablewright.errors import (
    BundleLengthError,
    MixedShapeError,
    PlanError,
    RequiredParamError,
    UnboundColumnError,
)
from tablewright.naming import BUNDLE_SEPARATOR
from tablewright.operators.literals import coerce

# The parameter types. A scalar takes a value or columns, a column only columns,
# a table the function's input, a source the name of another table.
SCALAR_TYPES = ("int", "float", "bool", "str", "date")
PARAM_TYPES = (*SCALAR_TYPES, "column", "table", "source")


@dataclass(frozen=True)
class Columns:
    """An ordered choice of columns for one parameter."""

    names: tuple[str, ...]


def cols(*names: str) -> Columns:
    return Columns(tuple(names))


@dataclass(frozen=True)
class Call:
    """One argument bundle: a column per column-backed parameter, and the shared values."""

    columns: Mapping[str, str] = field(default_factory=dict)
    values: Mapping[str, object] = field(default_factory=dict)
    sources: Mapping[str, str] = field(default_factory=dict)
    key: str = ""


def pair_columns(bound: Mapping[str, Columns]) -> list[tuple[dict[str, str], str]]:
    """Pair the i-th columns of all parameters that vary; a single column serves every bundle.

    Returns (columns by parameter, bundle key) pairs. The key names the varying columns, or all
    columns when nothing varies.
    """
    varying = {p: c.names for p, c in bound.items() if len(c.names) > 1}
    sizes = sorted({len(names) for names in varying.values()})
    if len(sizes) > 1:
        raise BundleLengthError(f"parameters vary over different numbers of columns: {sizes}")
    bundles = []
    for i in range(sizes[0] if sizes else 1):
        chosen = {p: c.names[i] if p in varying else c.names[0] for p, c in bound.items()}
        labels = [chosen[p] for p in (varying or bound)]
        bundles.append((chosen, BUNDLE_SEPARATOR.join(labels)))
    return bundles


def resolve_calls(params: Mapping[str, str], defaults: Mapping[str, object], bound: Mapping[str, object]) -> list[Call]:
    """The calls a binding stands for. ``params`` maps names to :data:`PARAM_TYPES`."""
    unknown = sorted(set(bound) - set(params))
    if unknown:
        raise PlanError(f"unknown parameters {unknown}")
    values: dict[str, object] = {}
    sources: dict[str, str] = {}
    columns: dict[str, Columns] = {}
    for name, kind in params.items():
        given = bound.get(name)
        if isinstance(given, Columns) and given.names:
            columns[name] = given
        elif kind in ("column", "table"):
            continue
        else:
            value = given if given is not None and not isinstance(given, Columns) else defaults.get(name)
            if value is None:
                raise RequiredParamError(name)
            if kind == "source":
                sources[name] = str(value)
            else:
                values[name] = coerce(value, kind)
    whole = [name for name in columns if params[name] == "column"]
    per_row = [name for name in columns if params[name] in SCALAR_TYPES]
    if whole and per_row:
        raise MixedShapeError(f"{whole} take whole columns but {per_row} take one value per row")
    return [Call(chosen, values, sources, key) for chosen, key in pair_columns(columns)]


def require_columns(params: Mapping[str, str], bound: Mapping[str, object]) -> None:
    """Every column parameter must be bound to at least one column."""
    for name, kind in params.items():
        given = bound.get(name)
        if kind == "column" and not (isinstance(given, Columns) and given.names):
            raise UnboundColumnError(name)
