"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_by_size


def _minima(sym: DataFrame, total: int) -> DataFrame:
    """Each (u, v) with m, the least of u and all its neighbours. Hubs meet their rows by broadcast."""
    least = sym.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    return join_by_size(sym, least, "u", "n", total).select("u", "v", F.least("u", "least").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reached; nodes without edges are absent.

    Every round replaces the edges by edges to smaller neighbours, keeps no more rows
    than before, and is checkpointed; after a logarithmic number of rounds only stars
    are left. Minima are partial aggregates, and a node with more than a thousandth of all
    edges gets its minimum by broadcast, so its edges stay spread over tasks. Loops, null
    ends and repeated edges are ignored.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).na.drop().where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = durable(now)
    total, mark = 2 * now.count(), None
    for _ in range(most_rounds if total else 0):
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minima(sym, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = durable(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        near = _minima(down, total)
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        now = durable(small)
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        total = 2 * seen[0]
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        if total:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
