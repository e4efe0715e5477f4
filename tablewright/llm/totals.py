"""Exclusive prefix sums over a whole table in a global order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import written


def running_totals(df: DataFrame, order: list[Column], sums: Mapping[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """Every row with, per named measure, the sum over all rows before it; and the grand totals.

    The rows are dealt by range of ``order`` and written once with the number of their part, so that a
    task that runs again sees the same parts. The driver gets one row of totals per part, whose number is
    bounded by the shuffle partitions. Inside a part a window adds up in order; no part holds more than its
    range, provided that ``order`` ends in columns that tell rows apart. Null measures count as zero. An
    empty table gives no rows and zero totals.
    """
    names = list(sums)
    measured = df.select("*", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"_m_{n}") for n, c in sums.items()])
    keys = [f"_k_{i}" for i in range(len(order))]
    keyed = measured.withColumns({k: c for k, c in zip(keys, [_value(c) for c in order], strict=True)})
    sorting = [_direct(o, k) for o, k in zip(order, keys, strict=True)]
    parts = written(keyed.repartitionByRange(*sorting).withColumn("_part", F.spark_partition_id()), "parts")

    per_part = parts.groupBy("_part").agg(*[F.sum(f"_m_{n}").alias(n) for n in names]).orderBy("_part").collect()
    offsets, so_far = [], dict.fromkeys(names, 0)
    for row in per_part:
        offsets.append((row["_part"], *[so_far[n] for n in names]))
        so_far = {n: so_far[n] + row[n] for n in names}
    spark = df.sparkSession
    schema = "_part int, " + ", ".join(f"_o_{n} long" for n in names)
    before = spark.createDataFrame(offsets, schema)

    inside = Window.partitionBy("_part").orderBy(*sorting).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = parts.join(F.broadcast(before), "_part").select(
        *df.columns,
        *[(F.sum(f"_m_{n}").over(inside) - F.col(f"_m_{n}") + F.col(f"_o_{n}")).alias(f"before_{n}") for n in names],
    )
    return totals, so_far


def _value(order: tuple[Column, bool] | Column) -> Column:
    return order[0] if isinstance(order, tuple) else order


def _direct(order: tuple[Column, bool] | Column, name: str) -> Column:
    """Ascending; ``(column, True)`` puts nulls last, else they come first."""
    return F.col(name).asc_nulls_last() if isinstance(order, tuple) and order[1] else F.col(name).asc_nulls_first()
