"""Column names, labels and result identities."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from tablewright.errors import UnknownColumnError

# Namespace of run results, length of a short id, label of an empty name,
# separator between the columns of a bundle key.
RESULT_NAMESPACE = uuid.UUID("1f0960df-5e2d-5d8c-b34b-d677bff4e791")
SHORT_ID_LENGTH = 8
EMPTY_LABEL = "result"
BUNDLE_SEPARATOR = "\x1f"


def quoted(name: str) -> str:
    """Back-quote a name so dots and spaces stay part of it."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def field_of(df: DataFrame, name: str) -> StructField:
    """The field called ``name``, matched the way Spark resolves names (ignoring case)."""
    wanted = name.lower()
    for field in df.schema.fields:
        if field.name.lower() == wanted:
            return field
    raise UnknownColumnError(name, df.columns)


def normalize_label(raw: str | None) -> str:
    """Collapse runs of odd characters to ``_``; never empty."""
    return re.sub(r"[^0-9A-Za-z]+", "_", raw or "").strip("_") or EMPTY_LABEL


def label_column(raw: Column) -> Column:
    """:func:`normalize_label` over a string column."""
    collapsed = F.regexp_replace(raw, "[^0-9A-Za-z]+", "_")
    trimmed = F.regexp_replace(collapsed, "^_|_$", "")
    return F.when(trimmed.isNull() | (trimmed == ""), EMPTY_LABEL).otherwise(trimmed)


def unused_name(name: str, existing) -> str:
    """``name``, or ``name_2``, ``name_3``… when it is taken."""
    taken = {e.lower() for e in existing}
    if name.lower() not in taken:
        return name
    n = 2
    while f"{name}_{n}".lower() in taken:
        n += 1
    return f"{name}_{n}"


def distinct_names(names) -> list[str]:
    """Suffix repeated names with ``_1``, ``_2``…; the first of each keeps its name."""
    seen: set[str] = set()
    out = []
    for name in names:
        final, n = name, 1
        while final.lower() in seen:
            final, n = f"{name}_{n}", n + 1
        seen.add(final.lower())
        out.append(final)
    return out


def short_id(*parts: str) -> str:
    """Deterministic eight-character identity of a result."""
    return uuid.uuid5(RESULT_NAMESPACE, "|".join(parts)).hex[:SHORT_ID_LENGTH]


def short_id_column(*parts: Column) -> Column:
    """:func:`short_id` over columns: a version-5 UUID starts with the SHA-1 of the name."""
    name = F.concat_ws("|", *parts)
    digest = F.sha1(F.concat(F.unhex(F.lit(RESULT_NAMESPACE.hex)), F.encode(name, "UTF-8")))
    return F.substring(digest, 1, SHORT_ID_LENGTH)


def transformed_id(table: str, version: int) -> str:
    """Identity of one version of a table's transformed output."""
    return short_id(table, "transformed", str(version))
