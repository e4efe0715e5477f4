"""Bounded samples of labelled documents, and the fixed fold that no model learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import pick

#: Most labelled documents a model is fitted on; the sample is joined by broadcast and fitted on the driver.
MOST_LABELLED = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id's digits is a multiple of five; a null id is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most ``most`` labelled documents outside the held-out fold.

    The ids are those with the smallest hashes, so the sample is the same each time. Null labels and ids are
    left out; of several labels of one document the larger counts, of several texts of one id the one with
    the smallest hash, chosen on the map side, however often the id repeats. The ids are at most ``most``, so
    the join to the documents broadcasts a bounded table.
    """
    known = pick(labels, doc_id="long", **{label: "int"}).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = pick(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    return texts.groupBy("doc_id", "label").agg(one.alias("one")).select("doc_id", "one.text", "label")
