"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its five-word shingles. Documents with the same set are one
node. Nodes that agree on a band of MinHash values are candidates; candidates are
compared on their MinHash values a block at a time, and a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold, given the matches so
far and a uniform prior, falls below the tolerance. All pairs that remain are verified
on their whole shingle sets.

Candidates are exactly the pairs that share a band, whatever the sizes of groups.

Where pairs meet. Buckets of different bands that hold the same nodes are one bucket. A
node's home is the largest bucket that it is in; homes are cut into blocks of ``BLOCK``
nodes. A pair of blocks that some bucket spans is one task, to which only the nodes of
such buckets go: near copies of one another meet once, in one task or a few, however many
bands they share, and buckets that merely share nodes are not compared with each other. A
bucket that spans more than ``WIDE`` blocks is cut into blocks of its own instead; pairs
that share no other bucket meet there, in the first such band that they share. So each
candidate pair is compared once. Tasks return no pairs but each node's number of links and
a spanning forest of the links, which is all that degrees and components need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import pairwise
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_by_size, prepare, words
from .components import connected_components

SHINGLE = 5
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: MinHash values looked at between two decisions.
STEP = 25
BLOCK = 256
WIDE = 24


@dataclass(frozen=True)
class JoinPlan:
    """threshold as a fraction; tolerance: posterior probability below which a pair is dropped."""

    top: int = 4
    bottom: int = 5
    tolerance: float = 1e-4
    seed: int = 1


class _WordHashes(dict):  # type: ignore[type-arg]
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; a shorter text is one shingle, a wordless one none."""
    found = words(text)
    h = np.array([_hashes[w] for w in found], dtype=np.uint64)
    if not h.size:
        return h
    width = min(SHINGLE, h.size)
    out = np.full(h.size - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3) + _mix(h[k : h.size - width + 1 + k])
    return np.unique(_mix(out))


def signature(s: np.ndarray, seed: int) -> np.ndarray:
    """16 bits of each MinHash value."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
    low = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, s.size, 1024):
        low = np.minimum(low, (s[at : at + 1024, None] * a + b).min(0))
    return (_mix(low) & np.uint64(0xFFFF)).astype("<u2")


def least_matches(plan: JoinPlan) -> dict[int, int]:
    """For each number of compared values, the least matches with which a pair stays.

    With m of n matches and a uniform prior, P(similarity >= t) is the probability of at
    most m successes in n + 1 trials of chance t.
    """
    t = plan.top / plan.bottom
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < plan.tolerance and m < n:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose matches never fall below the least."""
    matches = np.zeros(i.size, dtype=np.int32)
    for a, b in pairwise([0, *sorted(least)]):
        matches = matches + (sig[i, a:b] == sig[j, a:b]).sum(1)
        ok = matches >= least[b]
        i, j, matches = i[ok], j[ok], matches[ok]
    return i, j


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sets."""
    if i.size < 3 * len(sets) + 8:
        return np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(i, j, strict=True)], dtype=np.int64)
    used = np.unique(np.concatenate([i, j]))
    row = np.full(len(sets), -1)
    row[used] = np.arange(used.size)
    value = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(used.size), [sets[k].size for k in used])
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]  # values of one set only can't be shared
    both = np.zeros((used.size, used.size), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if column.size else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((used.size, width), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        both += m @ m.T
    return both[row[i], row[j]].astype(np.int64)


def linked(sig: np.ndarray, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, least: dict[int, int], plan: JoinPlan) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate pairs, those whose exact similarity reaches the threshold."""
    i, j = surviving(sig, i, j, least)
    n = np.array([s.size for s in sets], dtype=np.int64)
    fits = np.minimum(n[i], n[j]) * plan.bottom >= np.maximum(n[i], n[j]) * plan.top
    i, j = i[fits], j[fits]
    if not i.size:
        return i, j
    same = overlaps(sets, i, j)
    ok = same * plan.bottom >= (n[i] + n[j] - same) * plan.top
    return i[ok], j[ok]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each index is connected with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def fingerprints(docs: DataFrame, id_col: str, text_col: str, plan: JoinPlan) -> DataFrame:
    """(id, k1, k2, set, sig) for each row: k1 and k2 name the row's content, set names the shingle set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, sigs = [], []
            for t in b.column("text"):
                s = shingles(t.as_py())
                sets.append(blake2b(s.tobytes(), digest_size=16).digest() if s.size else None)
                sigs.append(signature(s, plan.seed).tobytes() if s.size else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "k1", "k2", "set", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), *content_keys(id_col, text_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, k1 long, k2 long, set binary, sig binary")


def content_keys(id_col: str, text_col: str) -> list:  # type: ignore[type-arg]
    """Two hashes that name a row by its id and text; they start from different values, so they are 128 bits together."""
    return [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)).alias(f"k{k}") for k in (1, 2)]


def near_groups(docs: DataFrame, plan: JoinPlan = JoinPlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id, class_id, n_links, k1, k2, component).

    n_links: the other rows whose similarity reaches the threshold, copies included.
    class_id: the smallest id of all rows connected by such links, the row's own id where
    there is none. Texts without words have no links; texts shorter than a shingle link
    with equal ones only. Repeated rows link with each other; null ids take part, and a
    class whose ids are all null has a null class_id. component numbers the classes, which
    class_id does not where ids are null or reused; texts without words have none. k1 and k2 name the row's content
    (``content_keys``). Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = least_matches(plan)
    rows = durable(fingerprints(docs, id_col, text_col, plan))
    some = rows.where(F.col("set").isNotNull())
    nodes = some.groupBy("set").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("first"), F.first(F.struct("k1", "k2", "sig")).alias("x"))
    nodes = durable(nodes.select(F.monotonically_increasing_id().alias("node"), "set", "w", "first", "x.k1", "x.k2", "x.sig"))

    band = lambda k: F.struct(F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)).alias("bucket"), F.lit(k).alias("band"), F.lit(1 << k).alias("bit"))
    bands = nodes.select("node", F.explode(F.array(*[band(k) for k in range(BANDS)])).alias("b")).select("node", "b.*")
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.min("node").alias("least")).where("n > 1")
    buckets = durable(buckets.groupBy("n", "x", "y", "least").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    n_nodes = nodes.count()
    members = join_by_size(bands, buckets, "bucket", "n", n_nodes)
    home = members.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("h")).select("node", "h.bucket", F.ceil(F.col("h.n") / BLOCK).alias("slots"))
    block = F.xxhash64(F.col("bucket"), F.pmod(F.xxhash64("node"), F.col("slots")))
    members = durable(members.join(home.select("node", block.alias("block")), "node"))

    spans = members.groupBy("bucket", "block").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    # A list of up to WIDE blocks, or none: longer ones are not gathered.
    wide = spans.groupBy("bucket").agg(F.count(F.lit(1)).alias("spread"))
    near = spans.join(wide.where(F.col("spread") <= WIDE), "bucket").groupBy("bucket").agg(F.collect_list(F.struct("block", "c")).alias("with"))
    sizes = durable(buckets.join(wide, "bucket").join(near, "bucket", "left"))
    known = durable(join_by_size(members.drop("n"), sizes, "bucket", "n", n_nodes))
    narrow = F.col("with").isNotNull()
    flags = known.groupBy("node").agg(F.bit_or(F.when(narrow, F.col("bit")).otherwise(0)).alias("narrow"), F.bit_or(F.when(~narrow, F.col("bit")).otherwise(0)).alias("wide"))
    partner = F.filter("with", lambda x: (x["block"] != F.col("block")) | (x["c"] > 1))
    few = known.where(narrow).select("node", "block", F.explode(partner).alias("o")).select("node", F.lit(0).cast("long").alias("g"), F.least("block", "o.block").alias("p"), F.greatest("block", "o.block").alias("q"), F.col("block").alias("own"), F.lit(-1).alias("band")).distinct()
    slots = F.ceil(F.col("n") / BLOCK).cast("long")
    many = known.where(~narrow).select("node", "bucket", "band", slots.alias("slots")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("slots"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    many = many.select("node", F.col("bucket").alias("g"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "band")
    work = durable(few.unionByName(many))

    asked = work.select("node").distinct().join(nodes.drop("set"), "node")
    texts = docs.select(*content_keys(id_col, text_col), F.col(text_col).alias("text"))
    # Equal content has equal keys; one row of it is enough.
    whole = asked.join(texts, ["k1", "k2"]).select("node", "w", "sig", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([shingles(t.as_py()).tobytes() for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], got], names=["node", "w", "sig", "shingles"])

    sets = whole.mapInArrow(cut, "node long, w long, sig binary, shingles binary").dropDuplicates(["node"])
    keys = ["g", "p", "q"]
    tasks = work.join(sets.join(flags, "node"), "node").repartition(parts, *keys).sortWithinPartitions(*keys, "node")
    found = durable(tasks.select(*keys, "own", "band", "node", "narrow", "wide", "w", "sig", "shingles").mapInArrow(lambda batches: _compare(batches, least, plan), "a long, b long, n long"))

    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    comp = connected_components(found.where("b is not null").select("a", "b"))
    joined = nodes.select("node", "set", "w", "first").join(comp, "node", "left").join(counts, "node", "left")
    joined = joined.withColumn("component", F.coalesce("component", "node"))
    joined = durable(joined)
    tops = joined.groupBy("component").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("n"))
    done = join_by_size(joined, tops, "component", "n", n_nodes).select("set", "class_id", "component", "w", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    done = durable(done)
    slim = rows.select("id", "k1", "k2", "set")
    out = join_by_size(slim.where(F.col("set").isNotNull()), done, "set", "w", done.agg(F.sum("w")).first()[0] or 0)
    out = out.select("id", "class_id", "n_links", "k1", "k2", "component")
    lone = slim.where(F.col("set").isNull()).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "k1", "k2", F.lit(None).cast("long").alias("component"))
    return out.unionByName(lone).withColumnRenamed("id", id_col)


def _compare(batches: Iterator[pa.RecordBatch], least: dict[int, int], plan: JoinPlan) -> Iterator[pa.RecordBatch]:
    """Of each run of rows with one key: a's number of links n, or an edge (a, b) of a forest of links."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None  # type: ignore[type-arg]

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows > 1:
            a, b, n = _group(table, least, plan)
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=b < 0), pa.array(n, pa.int64())], names=["a", "b", "n"])

    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in range(3)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            now = tuple(key[:, a].tolist())
            if now != last:
                yield from flush()
                held, last = [], now
            held.append(batch.slice(a, b - a))
    yield from flush()


def shared_bands(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits of the bands in which pairs agree."""
    return ((codes[i] == codes[j]) << np.arange(BANDS)).sum(1)


def candidates(codes: np.ndarray, narrow: np.ndarray, wide: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Which pairs are compared in a task: of blocks (band is -1) those that share a narrow bucket, of a wide bucket those that share none and no wide one of a band before."""
    both = shared_bands(codes, i, j)
    if band < 0:
        return (both & narrow[i]) != 0
    rest = both & wide[i]
    return ((both & narrow[i]) == 0) & ((rest & -rest) == 1 << band)


def _group(table: pa.Table, least: dict[int, int], plan: JoinPlan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = table.num_rows
    p, q, band = (table.column(k)[0].as_py() for k in ("p", "q", "band"))
    own, node, w, narrow, wide = (table.column(k).to_numpy() for k in ("own", "node", "w", "narrow", "wide"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype="<u2").reshape(n, HASHES)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
    mixed = sig.reshape(n, BANDS, ROWS).astype(np.uint64)
    codes = np.zeros((n, BANDS), dtype=np.uint64)
    for k in range(ROWS):
        codes = _mix(codes + mixed[:, :, k] + np.uint64(1))
    ii, jj = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    left, right = (np.arange(n), np.arange(n)) if p == q else (np.flatnonzero(own == p), np.flatnonzero(own == q))
    for at in range(0, left.size, 64):
        i, j = (x.ravel() for x in np.meshgrid(left[at : at + 64], right, indexing="ij"))
        if p == q:
            i, j = i[i < j], j[i < j]
        ok = candidates(codes, narrow, wide, i, j, band)
        i, j = surviving(sig, i[ok], j[ok], least)
        ii.append(i)
        jj.append(j)
    i, j = linked(sig, sets, np.concatenate(ii), np.concatenate(jj), least, plan)
    links = (np.bincount(i, weights=w[j], minlength=n) + np.bincount(j, weights=w[i], minlength=n)).astype(np.int64)
    root = _roots(n, i, j)
    some, forest = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
    return np.concatenate([node[some], node[forest]]), np.concatenate([np.full(some.size, -1), node[root[forest]]]), np.concatenate([links[some], np.zeros(forest.size, dtype=np.int64)])


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each class, the row of smallest id, and of repeated rows one.

    Rows are found again by their content keys; texts without words all stay, except
    repeated rows. All columns of docs return.
    """
    wordless = F.col("n_links") == 0
    best = groups.where(~wordless).groupBy("component").agg(F.min(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), "k1", "k2")).alias("x")).select("x.k1", "x.k2")
    keep = best.unionByName(groups.where(wordless).select("k1", "k2")).distinct()
    keyed = docs.select("*", *[c.alias(f"_k{k}") for k, c in enumerate(content_keys(id_col, text_col), 1)])
    keep = keep.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    return keyed.join(keep, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")
