"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import written

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to, for every node of the edges a, b (long).

    Every round, each node passes the smallest node it knows first to its larger neighbours, then to its
    smaller ones (Kiveris et al., 2014), until each component is a star around its smallest node. A round
    takes two aggregates and two joins on keys that adaptive execution can split; edges are never collected
    and their number never grows. Rounds are written to the shared folder. Self links and null ends are
    dropped, repeated links count once; no edges, no rows.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    links = written(links, "links")
    before = _state(links)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        links = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())


def _state(links: DataFrame) -> tuple:
    """Two equal states are the same links, up to a collision of 128 bits."""
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
