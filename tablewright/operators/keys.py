"""Key semantics of an ingest, as joins and two-phase aggregates over base and batch.

``batch`` may carry an order column that says which of several rows with one key came first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.naming import col, field_of
from tablewright.operators.casts import cast_of, to_text, uncastable

# The ingestion methods.
METHODS = ("upsert", "append", "skip")


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that are NULL or occur more than once, with their number of rows.

    Counts combine map-side, so a key that fills a third of the table is one row per task.
    """
    name = field_of(df, key).name
    counts = df.groupBy(col(name)).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.filter((F.col("n_rows") > 1) | col(name).isNull())


def converted_key_counts(df: DataFrame, key: str, new_type: str) -> DataFrame:
    """One row: ``castable, uncastable`` rows of a key column, and what the converted keys would violate,
    ``null_rows`` and ``repeated_keys``. One pass over one column; only keys and counts are shuffled."""
    grouped = df.groupBy(cast_of(df, key, new_type).alias("__k")).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(uncastable(df, key, new_type)).alias("__bad")
    )
    total, bad, null = F.sum("__n"), F.sum("__bad"), F.col("__k").isNull()
    return grouped.agg(
        F.coalesce(total - bad, F.lit(0)).alias("castable"),
        F.coalesce(bad, F.lit(0)).alias("uncastable"),
        F.coalesce(F.sum(F.when(null, F.col("__n"))), F.lit(0)).alias("null_rows"),
        F.count_if(~null & (F.col("__n") > 1)).alias("repeated_keys"),
    )


def converted_key_violations(df: DataFrame, key: str, new_type: str) -> DataFrame:
    """``key, n_rows, reason`` of converted keys that are NULL or meet in one value; ``key`` is that value as
    text."""
    name = field_of(df, key).name
    broken = key_violations(df.select(cast_of(df, key, new_type).alias(name)), name)
    reason = F.when(col(name).isNull(), "null").otherwise("repeated")
    return broken.select(to_text(col(name), broken.schema[name].dataType).alias("key"), "n_rows", reason.alias("reason"))


def first_rows(batch: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """One row per key: the first by ``order``. NULL keys are dropped.

    Keys that repeat are found by counting, which hashes the key column alone. Rows of other keys pass as
    they are; only the copies of repeated keys are compared, with ``min_by``, which keeps a single candidate
    per key and task where ``row_number`` would collect every copy of a hot key in one task.
    """
    name = field_of(batch, key).name
    present = batch.filter(col(name).isNotNull())
    repeated = present.groupBy(col(name).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__k")
    match = _key_match(name, "__k")
    row = F.struct(*[col(c) for c in batch.columns])
    copies = present.join(repeated, match, "left_semi").groupBy(col(name).alias("__key"))
    best = copies.agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")
    return present.join(repeated, match, "left_anti").unionByName(best)


def _key_match(left: str, right: str) -> Column:
    return col(left) == col(right)


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(col(key).alias("__k")).filter("__k is not null").distinct()


def existing_keys(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``__k``: the batch's keys that the base has, each once because the base is unique.

    The base streams past the batch's keys: a small batch is broadcast by its measured size and
    the base is not shuffled. The other way round, the whole base would be.
    """
    return base.select(col(key).alias("__b")).join(_keys(batch, key), _key_match("__b", "__k"), "left_semi").select(
        F.col("__b").alias("__k")
    )


def new_rows(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Batch rows whose key the base does not have."""
    return batch.join(existing_keys(base, batch, key), _key_match(key, "__k"), "left_anti")


def existing_rows(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Batch rows whose key the base already has."""
    return batch.join(existing_keys(base, batch, key), _key_match(key, "__k"), "left_semi")


def kept_rows(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Base rows that an upsert of the batch leaves alone; the base streams past the batch's keys."""
    return base.join(_keys(batch, key), _key_match(key, "__k"), "left_anti")


def replaced_rows(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Base rows that an upsert of the batch replaces."""
    return base.join(_keys(batch, key), _key_match(key, "__k"), "left_semi")


def append_conflicts(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``key, n_rows, reason`` of everything that makes an append of the batch fail.

    The base is already unique, so only the batch is grouped, and the base is read for its key.
    """
    name = field_of(batch, key).name
    inside = key_violations(batch, key)
    text = to_text(col(name), field_of(batch, key).dataType).alias("key")
    reason = F.when(col(name).isNull(), "null").otherwise("repeated")
    taken = existing_keys(base, batch, key).select(col("__k").alias(name))
    return inside.select(text, "n_rows", reason.alias("reason")).unionByName(
        taken.select(text, F.lit(1).cast("long").alias("n_rows"), F.lit("exists").alias("reason"))
    )


def append(base: DataFrame, batch: DataFrame) -> DataFrame:
    """All rows of both; valid only without :func:`append_conflicts`."""
    return base.unionByName(batch.select([col(c) for c in base.columns]))


def upsert(base: DataFrame, batch: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """A batch row replaces the base row with its key; the first copy of a repeated key counts."""
    winners = first_rows(batch, key, order).select([col(c) for c in base.columns])
    return kept_rows(base, batch, key).unionByName(winners)


def skip(base: DataFrame, batch: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Base rows, plus the first batch row of every key the base does not have."""
    fresh = new_rows(base, first_rows(batch, key, order), key)
    return base.unionByName(fresh.select([col(c) for c in base.columns]))


def skipped_keys(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """One key per batch row that a skip leaves out because the base has it."""
    name = field_of(batch, key).name
    return existing_rows(base, batch.select(col(name)), key)
