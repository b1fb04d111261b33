"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a hash, rows that repeat by their number
too, and its blocks are put in a permuted order. The mix takes whole passes over a source and then a leading run of
its permuted blocks; the block that the target cuts is taken document by document,
again in a permuted order. How many draws of each source go to which output shard is
decided by a tree: its root holds the exact quota of every source, each node halves
its shards and draws the left half's quotas from a multivariate hypergeometric
distribution, and the leaves are the shards. A shard's quota of a source is a run of
that source's draws, disjoint from all other shards' runs; inside a shard, rows are
ordered by a seeded hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, join_by_size

WEIGHTS = (5.0, 2.0, 1.0)
SOURCES = 10_000


@dataclass(frozen=True)
class MixPlan:
    """share: words of the mix over words of the input; cap: most uses of a source.

    Blocks have block_words words and block_docs documents, or more where the table would
    make more than most_blocks blocks of that size; sources of more than one of
    ``SOURCES`` documents have least_blocks blocks or more. So there are at most
    2 * most_blocks + least_blocks * SOURCES + sources blocks, which bounds the tables that
    are broadcast and the draws.
    """

    weights: tuple[float, ...] = WEIGHTS
    share: float = 1.5
    cap: float = 2.0
    shards: int = 16
    block_words: int = 1_000_000
    block_docs: int = 20_000
    least_blocks: int = 64
    most_blocks: int = 50_000
    most_sources: int = 1_000_000
    seed: int = 7


def word_count(text: Column) -> Column:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], plan: MixPlan) -> list[float]:
    """Share the mix by weight; what exceeds a source's cap is shared again among the rest."""
    n = len(sizes)
    weights = [plan.weights[i % len(plan.weights)] for i in range(n)]
    caps = [plan.cap * s for s in sizes]
    target, open_, left = [0.0] * n, set(range(n)), plan.share * sum(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if left * weights[i] / whole >= caps[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / whole
            break
        for i in full:
            target[i] = caps[i]
            open_.remove(i)
        left = max(0.0, plan.share * sum(sizes) - sum(target))
    return target


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Draws of each source (column) for each shard (row); columns add up to the quotas."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        take = round(total * (mid - lo) / (hi - lo))
        rng = np.random.default_rng([seed, lo, hi])
        left, rest = np.zeros_like(have), total
        for i, n in enumerate(have):  # the multivariate draw, one margin after the other
            rest -= int(n)
            left[i] = draw = int(rng.hypergeometric(int(n), rest, take)) if take and n else 0
            take -= draw
        node(lo, mid, left)
        node(mid, hi, have - left)

    if quotas and shards:
        node(0, shards, np.array(quotas, dtype=np.int64))
    return out


def numbered_repeats(rows: DataFrame) -> DataFrame:
    """Rows (h, part, ...) with ``h`` made different for rows that repeat, by their number.

    part is the partition a row was read in: repeats are numbered partition by partition, so
    that a row that makes up much of the table stays spread. Which of equal rows gets which
    number makes no difference.
    """
    repeats = durable(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    single = rows.join(repeats.select("h"), "h", "left_anti")
    again = join_by_size(rows, repeats, "h", "n", rows.count()).drop("n")
    held = again.groupBy("h", "part").agg(F.count(F.lit(1)).alias("c"))
    before = held.withColumn("before", F.sum("c").over(Window.partitionBy("h").orderBy("part")) - F.col("c")).drop("c")
    within = again.withColumn("k", F.row_number().over(Window.partitionBy("h", "part").orderBy("size")))
    again = within.join(before, ["h", "part"]).withColumn("h", F.xxhash64("h", F.col("before") + F.col("k"))).drop("before", "k")
    return single.unionByName(again).drop("part")


def mix_sources(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix, one row per document: (id, source, size, source_size, target, taken, shards, order_keys).

    taken: words the mix takes of the document, repeats counted; at most ``cap`` times
    its size. shards: the output shard of each of its draws, order_keys: its place there,
    for rows of a shard are shuffled by these keys. A source's taken words
    differ from its target by half a document at most. Sources, which are counted on
    the driver, may be ``most_sources`` at most; a hot source is many blocks and so
    many tasks. Null texts have size 0; a null source is a source of its own, last in
    order; repeated rows are rows of their own; null ids are kept; other columns are
    ignored. An empty table gives an empty result. Reruns agree.
    """
    spark = docs.sparkSession
    seed = F.lit(plan.seed)
    rows = durable(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(seed, F.col(id_col), F.col(text_col), F.col(source_col)).alias("h"), F.spark_partition_id().alias("part"))
    )
    rows = durable(numbered_repeats(rows))
    known = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(plan.most_sources + 1).collect()
    if len(known) > plan.most_sources:
        raise ValueError(f"more than {plan.most_sources} sources")
    known.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in known]
    targets = fill_targets(sizes, plan)
    table = []
    per_words = max(plan.block_words, ceil(sum(sizes) / plan.most_blocks))
    per_docs = max(plan.block_docs, ceil(sum(r["n"] for r in known) / plan.most_blocks))
    large = sum(r["n"] for r in known) / SOURCES
    for i, (r, t) in enumerate(zip(known, targets, strict=True)):
        passes = min(int(plan.cap), int(t // r["words"])) if r["words"] else 0
        rest = max(0.0, t - passes * r["words"]) if passes < plan.cap else 0.0
        blocks = max(plan.least_blocks if r["n"] > large else 1, ceil(r["words"] / per_words), ceil(r["n"] / per_docs))
        table.append((r["source"], i, r["words"], float(t), passes, rest, blocks))
    kinds = f"source {docs.schema[source_col].dataType.simpleString()}, src int, source_size long, target double, passes int, rest double, blocks long"
    sources = F.broadcast(spark.createDataFrame(table, kinds))

    dealt = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select("id", rows["source"], "size", "h", "src", "source_size", "target", "passes", F.pmod(F.xxhash64("h", seed), F.col("blocks")).alias("block"))
    totals = dealt.groupBy("src", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("src").orderBy(F.xxhash64("block", "src", seed), "block")
    per_source = F.broadcast(spark.createDataFrame([(x[1], x[4], x[5]) for x in table], "src int, passes int, rest double"))
    placed = (
        totals.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("place", F.row_number().over(order) - 1)
        .join(per_source, "src")
        .withColumn("before", F.col("upto") - F.col("words"))
        .withColumn("kind", F.when((F.col("upto") <= F.col("rest")) & (F.col("rest") > 0), "whole").when(F.col("before") < F.col("rest"), "cut").otherwise("out"))
    )
    placed = durable(placed.select("src", "block", "place", "before", "rest", "kind"))
    counted = {r["src"]: r for r in placed.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("kind") != "out").cast("long")).alias("more")).collect()}
    quotas = [x[4] * counted[x[1]]["n"] + counted[x[1]]["more"] for x in table]
    ends = np.cumsum(split_quotas(quotas, plan.shards, plan.seed), axis=0)
    bounds = F.broadcast(spark.createDataFrame([(x[1], x[4], counted[x[1]]["n"], ends[:, k].tolist()) for k, x in enumerate(table)], "src int, passes int, n long, ends array<long>"))

    def shard_of(draw: Column) -> Column:
        return F.size(F.filter("ends", lambda e: e <= draw)).cast("int")

    drawn = placed.join(bounds, "src").select(
        "src", "block", "before", "rest", "kind",
        F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda p: shard_of(p * F.col("n") + F.col("place")))).otherwise(F.array().cast("array<int>")).alias("full"),
        shard_of(F.col("passes") * F.col("n") + F.col("place")).alias("part"),
    )
    # The blocks have a bound (see MixPlan), so rows stay where they are; only those of cut blocks are put in order.
    joined = dealt.join(F.broadcast(drawn), ["src", "block"])
    inside = Window.partitionBy("src", "block").orderBy(F.xxhash64("h", F.lit(plan.seed + 1)), "h", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = joined.where(F.col("kind") == "cut").withColumn("upto", F.col("before") + F.sum("size").over(inside)).withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("upto")
    plain = joined.where(F.col("kind") != "cut").withColumn("extra", (F.col("kind") == "whole").cast("int"))
    every = plain.unionByName(cut)
    shards = F.when(F.col("extra") > 0, F.concat("full", F.array("part"))).otherwise(F.col("full"))
    key = lambda s, i: F.xxhash64("h", F.lit(plan.seed + 2), i, s)
    return every.withColumn("shards", shards).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("passes") + F.col("extra"))).alias("taken"),
        "shards",
        F.transform("shards", key).alias("order_keys"),
    )


def shard_rows(mix: DataFrame) -> DataFrame:
    """One row per draw, shuffled within its shard: ready to be written with partitionBy("shard").

    A shard's rows are spread over several tasks by ranges of the order key, so no
    task holds a whole shard.
    """
    draws = mix.select("*", F.explode(F.arrays_zip(F.col("shards").alias("shard"), F.col("order_keys").alias("order_key"))).alias("draw"))
    draws = draws.drop("shards", "order_keys").select("*", "draw.shard", "draw.order_key").drop("draw")
    return draws.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key")
