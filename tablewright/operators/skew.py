"""Outer joins that stay balanced when one key holds a large share of the rows.

AQE splits an oversized partition of a shuffled join on either side of an inner join and on the kept side of
an anti join, but not on the other side of an outer join, nor on any side of a full join. An outer join is
therefore composed of joins that it can split: the inner join, and the rows without a partner, found by an
anti join against the other side's distinct keys, of which none is hot. Rows with a NULL key have no partner
and skip the shuffle. The result equals the plain join, and nothing about the data has to be known.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.naming import col


def equal_keys(left_keys: list[str], right_keys: list[str]) -> Column:
    return reduce(and_, [col(a) == col(b) for a, b in zip(left_keys, right_keys, strict=True)])


def split_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str) -> DataFrame:
    """``left how right`` on equal keys. Column names of the two sides must not overlap."""
    parts = [left.join(right, equal_keys(left_keys, right_keys), "inner")]
    if how in ("left", "full"):
        parts += _unmatched(left, right, left_keys, right_keys)
    if how in ("right", "full"):
        parts += _unmatched(right, left, right_keys, left_keys)
    return reduce(lambda whole, part: whole.unionByName(part, allowMissingColumns=True), parts)


def _unmatched(rows: DataFrame, other: DataFrame, keys: list[str], other_keys: list[str]) -> list[DataFrame]:
    """Rows whose key is NULL, and rows whose key the other side does not have."""
    present = reduce(and_, [col(k).isNotNull() for k in keys])
    partners = other.select([col(k).alias(f"__p{i}") for i, k in enumerate(other_keys)]).distinct()
    on = reduce(and_, [col(k) == F.col(f"__p{i}") for i, k in enumerate(keys)])
    return [rows.filter(~present), rows.filter(present).join(partners, on, "left_anti")]
