"""Contiguous shards of equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import pick
from tablewright.llm.totals import running_totals


def byte_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Put every document into one of ``n_shards`` contiguous shards of nearly equal bytes.

    Documents are taken by ascending doc_id. The size of a document is its UTF-8 bytes plus one. Sizes are
    summed per partition, the totals of the partitions give every row its place in the whole corpus, and a
    row goes to the shard in whose equal share its middle byte lies. So the shards are runs of doc_ids and
    none is off its share by more than half a document at either end.

    Returns doc_id, size, text_crc32, shard and slot (the place in the shard, gapless from 0). Null and
    empty texts have size 1 and checksum 0. Null doc_ids come first. Rows with one doc_id lie next to each
    other, ordered by checksum and size; equal rows can change places without a change of the result.
    An empty table has no rows; extra columns are ignored. Only ids and sizes are shuffled, never texts.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows = pick(docs, doc_id="long", text="string").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed, totals = running_totals(rows, order, {"bytes": F.col("size"), "rows": F.lit(1)})
    shard = F.expr(f"({n_shards} * (before_bytes * 2 + size)) div {max(1, 2 * totals['bytes'])}")
    placed = placed.withColumn("shard", F.least(shard, F.lit(n_shards - 1)).cast("int"))

    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("before_rows").alias("first")).collect()}
    starts = F.create_map(*[F.lit(x).cast(k) for s in range(n_shards) for x, k in ((s, "int"), (first.get(s, 0), "long"))])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before_rows") - starts[F.col("shard")]).alias("slot"))
