"""Duplicate pairs: equal hashes, bucketed character-gram Jaccard, banded MinHash."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.text import grams, jaccard
from twinfold.operators.components import shared_checkpoint

# Strength of evidence of a pair, by type.
CODE_RANK = {"file_exact": 6, "file_normalized_exact": 5, "symbol_exact": 4, "config_duplicate": 3, "symbol_near": 2, "window_near": 1}
DOC_RANK = {"file_exact": 4, "text_exact": 3, "chunk_exact": 2, "chunk_near": 1}

#: Bands and rows that miss a pair of gram Jaccard 0.82 with a chance of 9e-6; the 9 of 14 that stand for the original library's choice miss it with 0.56.
SURE_BANDS = (25, 5)


def groups(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Keys that several rows share: (key, n, first). Empty and null keys count as none."""
    return rows.where(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first")).where("n > 1")


def star_links(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(left, right): the first item of each key with each other one; linear in a group's size and enough for components.

    Keys and items are written once, so what they are made of is not read and hashed twice.
    """
    rows = shared_checkpoint(rows.select(key, item))
    g = groups(rows, key, item)
    return rows.join(g, key).where(F.col(item) != F.col("first")).select(F.col("first").alias("left"), F.col(item).alias("right"))


def all_pairs(rows: DataFrame, key: str, item: str, apart: str | None = None) -> DataFrame:
    """(left, right) of all rows with an equal key, in order; apart: a column that must differ."""
    a, b = rows.where(F.col(key) != ""), rows.where(F.col(key) != "")
    a = a.select(F.col(key).alias("k"), F.col(item).alias("left"), *([F.col(apart).alias("pa")] if apart else []))
    b = b.select(F.col(key).alias("k"), F.col(item).alias("right"), *([F.col(apart).alias("pb")] if apart else []))
    out = a.join(b, "k").where("left < right")
    return (out.where("pa != pb") if apart else out).select("left", "right")


def exact_classes(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(k, item, representative, members, pairs): ``all_pairs`` without a row for each pair. Each row of a key that several share, with the least of them, how many there are and how many pairs they make."""
    n = F.col("n")
    return rows.join(groups(rows, key, item), key).select(F.col(key).alias("k"), F.col(item).alias("item"), F.col("first").alias("representative"), n.alias("members"), F.floor(n * (n - 1) / 2).cast("long").alias("pairs"))


def code_exact_pairs(chunks: DataFrame) -> DataFrame:
    """(left, right, similarity, duplicate_type) of chunks in different files with equal hashes."""
    specs = [("raw_hash", "file_exact", ["file"]), ("normalized_hash", "file_normalized_exact", ["file"]), ("normalized_hash", "symbol_exact", ["function", "class"]), ("normalized_hash", "config_duplicate", ["config"])]
    out = None
    for key, kind, kinds in specs:
        some = chunks.where(F.col("kind").isin(kinds)).withColumn("k", F.concat_ws("|", "kind", key))
        found = all_pairs(some, "k", "chunk_id", "path").select("left", "right", F.lit(1.0).alias("similarity"), F.lit(kind).alias("duplicate_type"))
        out = found if out is None else out.unionByName(found)
    return out  # type: ignore[return-value]


def bucket_candidates(chunks: DataFrame, item: str, path: str, block: list[str], count: str, bucket: int = 20, reach: int = 2) -> DataFrame:
    """Pairs of one block whose line counts fall in buckets at most ``reach`` apart: (left, right, same_path, ratio).

    One side is repeated for each bucket in reach, so each pair meets once and needs no
    distinct.
    """
    side = lambda n, b: chunks.select(*[F.col(c).alias(c) for c in block], F.col(item).alias(n), F.col(path).alias(f"{n}_path"), F.col(count).alias(f"{n}_count"), b.alias("bucket"))
    own = F.floor(F.col(count) / bucket)
    a = side("left", own)
    b = side("right", F.explode(F.sequence(own - reach, own + reach)))
    ratio = F.least("left_count", "right_count") / F.greatest("left_count", "right_count")
    return a.join(b, [*block, "bucket"]).where("left < right").select("left", "right", (F.col("left_path") == F.col("right_path")).alias("same_path"), ratio.alias("ratio"))


#: Rows of a block of near pairs; each pair of blocks is a task's group.
BLOCK = 2048
#: Columns of a dense piece, and up to how many pairs a gram's rows are listed.
PIECE, LISTED = 4096, 2048


def near_pairs(chunks: DataFrame, item: str, path: str, block: list[str], count: str, text: str, threshold: float = 0.86, least_ratio: float = 0.55, bucket: int = 20, reach: int = 2) -> DataFrame:
    """Bucketed pairs in different paths with gram Jaccard of threshold or more: (left, right, shared, every, similarity).

    All candidates of ``bucket_candidates`` are looked at, but none is a row before it
    passes: rows are dealt into blocks, pairs of blocks in reach of each other meet in Arrow
    batches, and grams common to many rows are counted by products of matrices.
    """
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind, c, n = chunks.schema[item].dataType.simpleString(), F.col, F.count(F.lit(1))
    rows = chunks.select(*[c(b).alias(f"b{i}") for i, b in enumerate(block)], c(item).alias("id"), c(path).alias("path"), c(count).cast("double").alias("count"), F.lower(c(text)).alias("text"))
    keys = [f"b{i}" for i in range(len(block))]
    rows = rows.where(" and ".join(f"{x} is not null" for x in [*keys, "id", "path", "count", "text"])).withColumn("bucket", F.floor(c("count") / bucket).cast("long")).withColumn("salt", F.xxhash64("id", "text"))
    sizes = rows.groupBy(*keys, "bucket").agg(F.ceil(n / BLOCK).cast("int").alias("blocks"))
    # Each bucket with those in reach behind it; a block meets its own bucket's later blocks and all of theirs.
    behind = sizes.select(*keys, F.explode(F.sequence(c("bucket") - reach, c("bucket"))).alias("low"), c("bucket").alias("high"), c("blocks").alias("high_blocks"))
    meets = sizes.select(*keys, c("bucket").alias("low"), c("blocks").alias("low_blocks")).join(behind, [*keys, "low"])
    span = lambda to: F.explode(F.sequence(F.lit(0), c(to) - 1))
    own = lambda of: F.pmod("salt", c(of)).cast("int")
    first = rows.withColumn("low", c("bucket")).join(F.broadcast(meets), [*keys, "low"]).withColumn("p", own("low_blocks")).withColumn("q", span("high_blocks")).where("low < high or p <= q").withColumn("side", F.lit(0))
    second = rows.withColumn("high", c("bucket")).join(F.broadcast(meets), [*keys, "high"]).withColumn("q", own("high_blocks")).withColumn("p", span("low_blocks")).where("low < high or p < q").withColumn("side", F.lit(1))
    task = [*keys, "low", "high", "p", "q"]
    cols = [F.xxhash64(*task).alias("task"), (F.col("low") == F.col("high")).alias("level"), c("p"), c("q"), c("side"), c("id"), F.xxhash64("path").alias("path"), c("count"), c("text")]
    dealt = first.select(*cols).unionByName(second.select(*cols)).repartition(max(parts, 1), "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            yield from _block_pairs(table, threshold, least_ratio)

    found = dealt.mapInArrow(run, f"left {kind}, right {kind}, shared long, every long")
    return found.withColumn("similarity", F.when(c("every") == 0, 1.0).otherwise(c("shared") / c("every")))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task; a task's rows follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        task = batch.column("task").to_numpy()
        cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            if b > a:
                if held and task[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = task[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _block_pairs(table: pa.Table, threshold: float, least_ratio: float) -> Iterator[pa.RecordBatch]:
    side = table.column("side").to_numpy()
    alone = bool(table.column("level")[0].as_py()) and table.column("p")[0].as_py() == table.column("q")[0].as_py()
    x, y = (np.arange(side.size),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not x.size or not y.size:
        return
    sets = [gram_hashes(t.as_py()) for t in table.column("text")]
    size = np.array([g.size for g in sets], dtype=np.int32)
    shared = shared_grams([sets[i] for i in x], [sets[i] for i in y])
    ids, n, path = table.column("id").combine_chunks(), table.column("count").to_numpy(), table.column("path").to_numpy()
    rank = np.unique(np.array(ids.to_pylist()), return_inverse=True)[1]
    for at in range(0, x.size, 256):
        i = x[at : at + 256, None]
        both = shared[at : at + 256]
        every = size[i] + size[y] - both
        with np.errstate(divide="ignore", invalid="ignore"):
            near = np.where(every == 0, 1.0, both / every) >= threshold
            near &= np.minimum(n[i], n[y]) / np.maximum(n[i], n[y]) >= least_ratio
        near &= path[i] != path[y]
        near &= rank[i] < rank[y] if alone else rank[i] != rank[y]
        r, k = np.nonzero(near)
        for cut in range(0, r.size, 65536):
            rr, kk = r[cut : cut + 65536], k[cut : cut + 65536]
            a, b = i[rr, 0], y[kk]
            swap = rank[a] > rank[b]
            left, right = np.where(swap, b, a), np.where(swap, a, b)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(both[rr, kk].astype(np.int64)), pa.array(every[rr, kk].astype(np.int64))], names=["left", "right", "shared", "every"])


def shared_grams(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each set of xs has in common with each of ys, exactly: rare values list their pairs, frequent ones are columns of 0 and 1."""
    out = np.zeros((len(xs), len(ys)), dtype=np.int32)
    flat = [np.concatenate([np.empty(0, dtype=np.uint64), *s]) for s in (xs, ys)]
    owner = [np.repeat(np.arange(len(s)), [g.size for g in s]) for s in (xs, ys)]
    common = np.intersect1d(*flat)
    if not common.size:
        return out
    cols = []
    for k in (0, 1):
        at = np.minimum(np.searchsorted(common, flat[k]), common.size - 1)
        known = np.flatnonzero(common[at] == flat[k])
        order = np.argsort(at[known], kind="stable")
        cols.append((at[known][order], owner[k][known][order]))
    df = [np.bincount(c[0], minlength=common.size) for c in cols]
    start = [np.cumsum(d) - d for d in df]
    pairs = df[0] * df[1]
    rare = np.flatnonzero(pairs <= LISTED)
    upto = np.cumsum(pairs[rare])
    for some in np.split(rare, np.searchsorted(upto, np.arange(1 << 20, int(upto[-1]) if rare.size else 0, 1 << 20))):
        m = pairs[some]
        g = np.repeat(some, m)
        k = np.arange(g.size) - np.repeat(np.cumsum(m) - m, m)
        i, j = cols[0][1][start[0][g] + k // df[1][g]], cols[1][1][start[1][g] + k % df[1][g]]
        np.add.at(out, (i, j), 1)
    often = np.flatnonzero(pairs > LISTED)
    for at in range(0, often.size, PIECE):
        some = often[at : at + PIECE]
        dense = []
        for k in (0, 1):
            m = df[k][some]
            where = np.repeat(start[k][some], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            grid = np.zeros((len((xs, ys)[k]), some.size), dtype=np.float32)
            grid[cols[k][1][where], np.repeat(np.arange(some.size), m)] = 1
            dense.append(grid)
        out += (dense[0] @ dense[1].T).astype(np.int32)
    return out


def score_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact Jaccard of (left, right) pairs over (id, g) gram sets, with integer counts."""
    a = sets.select(F.col("id").alias("left"), F.col("g").alias("ga"))
    b = sets.select(F.col("id").alias("right"), F.col("g").alias("gb"))
    j = pairs.join(a, "left").join(b, "right").withColumn("shared", F.size(F.array_intersect("ga", "gb"))).withColumn("every", F.size("ga") + F.size("gb") - F.col("shared"))
    return j.select("left", "right", F.col("shared").cast("long").alias("shared"), F.col("every").cast("long").alias("every"), jaccard(F.col("ga"), F.col("gb")).alias("similarity"))


def score_texts(pairs: DataFrame, texts: DataFrame, held: int = 1024) -> DataFrame:
    """``score_pairs`` over (id, t) lower-cased texts, whose grams are made where pairs meet.

    Ids are dealt into slots of about ``held``, and the pairs of two slots are a group: a
    text is sent once to each group that has a pair of it, not once for each pair. Both
    inputs are read more than once and should be cheap or durable.
    """
    kind, parts = pairs.schema["left"].dataType.simpleString(), int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(8, -(-texts.select("id").count() // held))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    placed = pairs.select("left", "right", (slot("left") * slots + slot("right")).alias("task"))
    needed = placed.select("task", F.col("left").alias("id")).unionByName(placed.select("task", F.col("right").alias("id"))).distinct()
    sent = needed.join(texts, "id").select("task", "id", F.lit(None).cast(kind).alias("right"), F.coalesce("t", F.lit("")).alias("t"))
    rows = sent.unionByName(placed.select("task", F.col("left").alias("id"), "right", F.lit(None).cast("string").alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            sets = {i: gram_hashes(t) for i, t in zip(table.column("id").to_pylist(), table.column("t").to_pylist(), strict=True) if t is not None}
            asked = [(x, y) for x, y in zip(table.column("id").to_pylist(), table.column("right").to_pylist(), strict=True) if y is not None and x in sets and y in sets]
            shared = [np.intersect1d(sets[x], sets[y], assume_unique=True).size for x, y in asked]
            every = [sets[x].size + sets[y].size - n for (x, y), n in zip(asked, shared, strict=True)]
            ids = [pa.array([xy[k] for xy in asked], table.schema.field("id").type) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(shared, pa.int64()), pa.array(every, pa.int64())], names=["left", "right", "shared", "every"])

    met = rows.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(run, f"left {kind}, right {kind}, shared long, every long")
    return met.withColumn("similarity", F.when(F.col("every") == 0, 1.0).otherwise(F.col("shared") / F.col("every")))


def _paired(rows: DataFrame, keys: list[str], count: str, least_ratio: float, bucket: int = 20, reach: int = 2) -> DataFrame:
    """One row, (n, far): the pairs of rows with equal keys whose counts fall in buckets at most ``reach`` apart, and those whose ratio is too low; from how often each count occurs."""
    held = rows.groupBy(*keys, F.col(count).alias("a")).agg(F.count(F.lit(1)).alias("ca")).withColumn("bucket", F.floor(F.col("a") / bucket))
    later = held.withColumnsRenamed({"a": "b", "ca": "cb"}).withColumn("bucket", F.explode(F.sequence(F.col("bucket") - reach, F.col("bucket"))))
    n = F.when(F.col("a") == F.col("b"), F.floor(F.col("ca") * (F.col("ca") - 1) / 2)).otherwise(F.col("ca") * F.col("cb"))
    met = held.join(later, [*keys, "bucket"]).where("a <= b").select(n.cast("long").alias("n"), (F.col("a") / F.col("b") < least_ratio).alias("far"))
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("far"), F.col("n"))), F.lit(0)).alias("far"))


def pair_counters(chunks: DataFrame, item: str, path: str, block: list[str], count: str, least_ratio: float = 0.55) -> DataFrame:
    """One row: candidate_pairs, jaccard_comparisons, skipped_same_path, skipped_length of ``bucket_candidates``.

    No pair is made: rows are counted by their counts, and products of such numbers are
    added up. Pairs of one item, which are no candidates, are taken off in the same way.
    """
    rows = chunks.select(*block, F.col(item).alias("item"), F.col(path).alias("path"), F.col(count).alias("count")).where(F.col("item").isNotNull() & F.col("count").isNotNull())
    again = rows.groupBy(*block, "item").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    twice = rows.join(again, [*block, "item"], "left_semi")
    placed, placed_twice = rows.where("path is not null"), twice.where("path is not null")
    parts = [("every", 1, rows, block), ("every", -1, twice, [*block, "item"]), ("placed", 1, placed, block), ("placed", -1, placed_twice, [*block, "item"]), ("same", 1, placed, [*block, "path"]), ("same", -1, placed_twice, [*block, "item", "path"])]
    out = None
    for what, sign, some, keys in parts:
        one = _paired(some, keys, "count", least_ratio).select(F.lit(what).alias("what"), (F.col("n") * sign).alias("n"), (F.col("far") * sign).alias("far"))
        out = one if out is None else out.unionByName(one)
    total = lambda what, c: F.sum(F.when(F.col("what") == what, F.col(c)).otherwise(0))
    apart, far = total("placed", "n") - total("same", "n"), total("placed", "far") - total("same", "far")
    return out.agg(total("every", "n").alias("candidate_pairs"), (apart - far).alias("jaccard_comparisons"), total("same", "n").alias("skipped_same_path"), far.alias("skipped_length"))  # type: ignore[union-attr]


#: Odd factors of the characters of a gram.
FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_values(text: str, n: int = 5) -> np.ndarray:
    """64-bit hashes of the character n-grams in their order, from code points; a short text is one gram, an empty one none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    width = min(n, points.size)
    if not width:
        return points
    h = np.full(points.size - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h += points[k : points.size - width + 1 + k] * FACTORS[k]
    h = (h ^ (h >> np.uint64(29))) * FACTORS[n]
    return h ^ (h >> np.uint64(32))


def gram_hashes(text: str, n: int = 5) -> np.ndarray:
    """Sorted and distinct ``gram_values``."""
    return np.unique(gram_values(text, n))


def gram_sets(text: Column) -> Column:
    """``gram_hashes`` of the lower-cased text as an array of longs, made in Arrow batches."""

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: gram_hashes(t or "").view(np.int64))

    return sets(F.lower(text))


#: Grams that are hashed at once, so that the products stay in the cache, and how many are worth sorting for copies first.
STEP, SORTED = 256, 4096


def minhash(text: Column, perms: int = 128, seed: int = 1) -> Column:
    """MinHash signature of the normalised text's 5-grams; the empty set hashes as one empty gram. Texts leave their Arrow batch one at a time."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 61, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 62, perms, dtype=np.uint64)

    def one(t: str, held: np.ndarray) -> np.ndarray:
        h = gram_values(t) if t else np.zeros(1, dtype=np.uint64)
        h = np.unique(h) if h.size > SORTED else h
        low = np.full(perms, np.iinfo(np.uint64).max)
        for at in range(0, h.size, STEP):
            some = h[at : at + STEP, None]
            got = np.multiply(some, a, out=held[: some.size])
            got += b
            np.minimum(low, got.min(0), out=low)
        return (low >> np.uint64(2)).astype(np.int64)

    @F.arrow_udf("array<long>")
    def sign(texts: pa.Array) -> pa.Array:
        held, out = np.empty((STEP, perms), dtype=np.uint64), np.empty((len(texts), perms), dtype=np.int64)
        for i, t in enumerate(texts):
            out[i] = one(t.as_py() or "", held)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * perms), pa.array(out.ravel()))

    return sign(F.lower(text))


def gram_count(text: Column) -> Column:
    """Number of the grams that ``minhash`` looks at. Texts leave their Arrow batch one at a time."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([gram_hashes(t.as_py() or "").size for t in texts], pa.int64())

    return count(F.lower(text))


def within_ratio(cand: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (left, right) whose set sizes, (id, n), allow a Jaccard of threshold; leaves no such pair out."""
    a, b = (sizes.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}")) for side in ("left", "right"))
    return cand.join(a, "left").join(b, "right").where(F.least("n_left", "n_right") >= threshold * F.greatest("n_left", "n_right") - 1e-6).select("left", "right")


def lsh_candidates(signed: DataFrame, item: str, bands: int = 9, rows: int = 14) -> DataFrame:
    """(left, right) that agree on a band of their signatures ``sig``; only ids and band hashes are shuffled."""
    keyed = signed.select(F.col(item).alias("id"), F.explode(band_hashes(F.col("sig"), bands, rows)).alias("band"))
    return band_candidates(keyed)


def band_hashes(sig: Column, bands: int, rows: int) -> Column:
    """One hash for each band of a signature."""
    return F.array(*[F.xxhash64(F.slice(sig, k * rows + 1, rows), F.lit(k)) for k in range(bands)])


def band_candidates(keyed: DataFrame) -> DataFrame:
    """(left, right) of (id, band) rows with an equal band."""
    keyed = keyed.where(F.col("band").isNotNull())
    return keyed.withColumnRenamed("id", "left").join(keyed.withColumnRenamed("id", "right"), "band").where("left < right").select("left", "right").distinct()


def estimate(a: Column, b: Column) -> Column:
    """Share of equal slots of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)) / F.size(a)


def best_pairs(pairs: DataFrame, rank: dict[str, int]) -> DataFrame:
    """Of each unordered pair the strongest type, ties by higher similarity."""
    strength = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("duplicate_type")]
    keyed = pairs.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "similarity", "duplicate_type", strength.alias("r"))
    return keyed.groupBy("left", "right").agg(F.max_by(F.struct("similarity", "duplicate_type"), F.struct("r", "similarity")).alias("x")).select("left", "right", "x.similarity", "x.duplicate_type")


def representative_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id): the least chunk id of each document."""
    return chunks.groupBy("doc_id").agg(F.min("chunk_id").alias("chunk_id"))


def capped(pairs: DataFrame, most: int, order: list[str]) -> DataFrame:
    """Candidate pairs with ``compared``: whether the pair is among the first ``most`` of a fixed order, where the engine's comparison cap stops.

    The order is spread by ranges: places are counted range by range, so no task sees all pairs.
    """
    ranged = shared_checkpoint(pairs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # one row a partition
    return ranged.join(F.broadcast(before), "part").withColumn("compared", F.col("before") + F.col("at") - F.col("first") < most).drop("part", "at", "first", "before")
