"""Exact top-k inner products: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import pick, written

#: Vectors of a shard and queries of a block, the most that one task holds.
SHARD = 50_000
BLOCK = 10_000
#: Vectors of a leaf.
LEAF = 64
_LOWEST = np.iinfo(np.int64).min


@dataclass
class Node:
    low: int
    high: int
    center: np.ndarray
    radius: float
    children: tuple[Node, Node] | None


class BallTree:
    """Vectors split in halves along the line between two far points, each node with its enclosing ball."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.order = np.arange(len(ids))
        self.vectors = vectors.astype(np.float64)
        self.root = self._node(0, len(ids))
        self.ids, self.exact = ids[self.order], vectors[self.order]
        self.vectors = self.vectors[self.order]

    def _node(self, low: int, high: int) -> Node:
        points = self.vectors[self.order[low:high]]
        center = points.mean(axis=0)
        away = ((points - center) ** 2).sum(axis=1)
        node = Node(low, high, center, math.sqrt(away.max()), None)
        if high - low > LEAF and away.max() > 0:
            one = points[np.argmax(away)]
            other = points[np.argmax(((points - one) ** 2).sum(axis=1))]
            middle = (high - low) // 2
            self.order[low:high] = self.order[low:high][np.argpartition(points @ (other - one), middle)]
            node.children = (self._node(low, low + middle), self._node(low + middle, high))
        return node

    def top(self, own: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query the k best vectors of other ids, as (found, scores, ids), best first, smaller ids on ties.

        ``least`` are scores that the queries already have k of elsewhere; what can't reach them is not
        looked for. All queries of the block go down together: a node is left by those whose kth score its
        bound q·c + |q| r doesn't reach, and the child with the higher bounds comes first.
        """
        m = len(queries)
        real = queries.astype(np.float64)
        norm = np.sqrt((real**2).sum(axis=1))
        scores, ids = np.full((m, k), _LOWEST), np.full((m, k), np.iinfo(np.int64).max)
        large = float(np.abs(real).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * max(1, real.shape[1])
        small = large < 2**52

        def reach(node: Node, who: np.ndarray) -> np.ndarray:
            bound = real[who] @ node.center + norm[who] * node.radius
            return bound + 0.5 + 1e-9 * (np.abs(bound) + norm[who] * (node.radius + np.sqrt((node.center**2).sum())))

        stack = [(self.root, np.arange(m), reach(self.root, np.arange(m)))]
        while stack:
            node, who, bound = stack.pop()
            who = who[bound >= np.maximum(least[who], scores[who, -1])]
            if not len(who):
                continue
            if node.children:
                bounds = [reach(c, who) for c in node.children]
                after = sorted(zip(node.children, bounds, strict=True), key=lambda x: x[1].mean())
                stack += [(child, who, b) for child, b in after]
                continue
            for low in range(node.low, node.high, 4 * LEAF):  # a leaf of equal points may be large
                span = slice(low, min(low + 4 * LEAF, node.high))
                if small:
                    got = (real[who] @ self.vectors[span].T).astype(np.int64)
                else:
                    got = queries[who] @ self.exact[span].T
                names = np.broadcast_to(self.ids[span], got.shape)
                got = np.where(names == own[who][:, None], _LOWEST, got)
                better = (got >= scores[who, -1][:, None]).any(axis=1)
                if not better.any():
                    continue
                now = who[better]
                all_scores = np.concatenate([scores[now], got[better]], axis=1)
                all_ids = np.concatenate([ids[now], np.where(got[better] == _LOWEST, np.iinfo(np.int64).max, names[better])], axis=1)
                best = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]  # ~ reverses the order and can't overflow
                scores[now] = np.take_along_axis(all_scores, best, 1)
                ids[now] = np.take_along_axis(all_ids, best, 1)
        return scores != _LOWEST, scores, ids


def scaled(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of every component, as long; null for a vector that is null, or has a null, NaN or
    infinite component."""
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(factor) * x).cast("long")))


def _search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top k of every shard for every query that comes with it."""

    def run(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "query_id", "score", "vec_id"]
        if vectors.empty or asked.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        tree = BallTree(vectors["vec_id"].to_numpy(), np.stack(vectors["v"].to_numpy()))
        found, scores, ids = tree.top(asked["query_id"].to_numpy(), np.stack(asked["q"].to_numpy()), k, asked["least"].to_numpy())
        row = np.nonzero(found)[0]
        return pd.DataFrame(
            {"query": asked["query"].to_numpy()[row], "query_id": asked["query_id"].to_numpy()[row], "score": scores[found], "vec_id": ids[found]}
        )

    key = ["size", "shard", "block"]
    schema = "query long, query_id long, score long, vec_id long"
    return candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(run, schema)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query with vectors of other ids.

    ``vectors`` has vec_id and v, ``queries`` query_id and q, both arrays of long; nulls are left out, and
    only vectors of a query's own length are compared. Ties go to the smaller vec_id. A query with fewer
    than k candidates gets all. Several vectors of one id each count; of several queries with one id the
    smallest vector asks. Sums beyond 64 bits wrap around.

    Vectors are dealt to shards and queries to blocks of bounded size, and every block meets every shard. All
    queries search the first shard; the kth score they find there goes with them to the others, where it
    prunes from the start, and rises as they search on.
    """
    vectors = vectors.filter("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("size", F.size("v")).filter("size > 0")
    queries = queries.filter("query_id IS NOT NULL AND q IS NOT NULL").groupBy("query_id").agg(F.min("q").alias("q"))
    queries = queries.withColumn("size", F.size("q")).filter("size > 0")
    vectors, queries = written(vectors.select("vec_id", "v", "size"), "vectors"), written(queries, "queries")
    shards = max(1, -(-vectors.count() // shard))
    blocks = max(1, -(-queries.count() // block))

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select("*", F.col("query_id").alias("query"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))

    def to(first: int, last: int, who: DataFrame) -> DataFrame:
        each = who.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last))))
        return _search(dealt.filter(F.col("shard").between(first, last)), each, k)

    found = to(0, 0, asked.withColumn("least", F.lit(int(_LOWEST)).cast("long")))
    if shards > 1:
        found = written(found, "first_shard")
        kth = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(int(_LOWEST))).alias("least"))
        bounded = asked.join(kth, "query", "left").withColumn("least", F.coalesce("least", F.lit(int(_LOWEST)).cast("long")))
        found = found.union(to(1, shards - 1, bounded))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``top_products`` of the rows whose vec_id is divisible by ``every`` against all rows, on scaled vectors."""
    rows = pick(embeddings, vec_id="long", embedding="array<double>").select("vec_id", scaled(F.col("embedding")).alias("v"))
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return top_products(rows, queries, k, shard, block)
