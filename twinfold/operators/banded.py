"""Sums over all pairs that share a MinHash band, without a row for each pair.

A bucket holds the texts that agree on a band. Whatever its size, it is cut into blocks,
and each pair of blocks is a task. A pair counts in the first band on which it agrees, so
once, however many buckets hold it. Tasks return a spanning forest of the links and, for
each tree, how many pairs it has and the sum of their scores; that is all that clusters
and means need.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.components import shared_checkpoint

BANDS, ROWS = 9, 14
BLOCK = 2048
#: Scores are summed as whole numbers of this part.
UNIT = 10_000


def band_rows(signed: DataFrame) -> DataFrame:
    """(id, k, band): the bands of each signature."""
    hashes = F.array(*[F.xxhash64(F.slice("sig", k * ROWS + 1, ROWS), F.lit(k)) for k in range(BANDS)])
    return signed.where(F.col("sig").isNotNull()).select("id", F.posexplode(hashes).alias("k", "band"))


def near_sums(signed: DataFrame) -> DataFrame:
    """(a, b, pairs, total) of signed: (id string, n long, sig array<int>), one row for each text.

    b not null: an edge between two texts of one component. b null: pairs of texts around a
    that share a band and do not agree on the whole signature, each weighing the product of
    both n, and the sum of their scores rounded to four places, times ``UNIT``.
    """
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = band_rows(signed)
    buckets = bands.groupBy("k", "band").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.min("id").alias("least")).where("m > 1")
    # Of buckets with the same texts the first has all pairs that count.
    buckets = buckets.groupBy("m", "x", "y", "least").agg(F.min(F.struct("k", "band")).alias("s")).select("s.k", "s.band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = bands.join(buckets, ["k", "band"]).withColumn("own", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["k", "band", "p", "q"]
    tasks = dealt.select("id", "k", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own").join(signed, "id")
    tasks = tasks.select(*keys, "own", "id", "n", "sig").repartition(parts, *keys).sortWithinPartitions(*keys, "id")
    return shared_checkpoint(tasks.mapInArrow(_runs, "a string, b string, pairs long, total double"))


def rounded(matches: np.ndarray, slots: int) -> np.ndarray:
    """Scores of so many equal slots, to four places, in ``UNIT``."""
    return np.array([round(round(k / slots, 4) * UNIT) for k in range(slots + 1)], dtype=np.int64)[matches]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    last: tuple | None = None  # type: ignore[type-arg]
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in range(4)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            now = tuple(key[:, a].tolist()) if b > a else last
            if now != last:
                yield from _sums(held)
                held, last = [], now
            held.append(batch.slice(a, b - a))
    yield from _sums(held)


def _sums(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held) if held else None
    if table is None or table.num_rows < 2:
        return
    size = table.num_rows
    band, p, q = (table.column(c)[0].as_py() for c in ("k", "p", "q"))
    own, w = table.column("own").to_numpy(), table.column("n").to_numpy()
    sig = np.concatenate([c.flatten().to_numpy() for c in table.column("sig").chunks]).reshape(size, -1)
    slots = sig.shape[1]
    if size > 64:  # small numbers for equal values compare faster
        sig = np.stack([np.unique(sig[:, s], return_inverse=True)[1] for s in range(slots)], axis=1).astype(np.uint16)
    sides = (np.arange(size), np.arange(size)) if p == q else (np.flatnonzero(own == p), np.flatnonzero(own == q))
    label, pairs, total = np.arange(size), np.zeros(size, dtype=np.int64), np.zeros(size)
    bands = sig[:, : BANDS * ROWS].reshape(size, BANDS, ROWS)
    earlier = [np.unique(bands[:, k], axis=0, return_inverse=True)[1].ravel() for k in range(band)] if size > 64 else None
    for i in sides[0]:
        j = sides[1][sides[1] > i] if p == q else sides[1]
        if earlier is None:
            met = (bands[j, :band] == bands[i, :band]).all(2).any(1)
        else:
            met = np.zeros(j.size, dtype=bool)
            for code in earlier:
                met |= code[j] == code[i]
        j = j[~met]
        matches = (sig[j] == sig[i]).sum(1)
        j, matches = j[matches < slots], matches[matches < slots]
        if not j.size:
            continue
        pairs[i] = w[i] * w[j].sum()
        total[i] = float(w[i]) * (w[j] * rounded(matches, slots)).sum(dtype=np.float64)
        found = np.unique(np.append(label[j], label[i]))
        if found.size > 1:
            label[np.isin(label, found)] = found[0]
    ids = np.array(table.column("id").to_pylist(), dtype=object)
    below, tops = np.flatnonzero(label != np.arange(size)), np.unique(label[pairs > 0])
    n, t = np.zeros(size, dtype=np.int64), np.zeros(size)
    np.add.at(n, label, pairs)
    np.add.at(t, label, total)
    a = [*ids[below], *ids[tops]]
    if a:
        zero = np.zeros(below.size, dtype=np.int64)
        b = [*ids[label[below]], *[None] * tops.size]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(np.append(zero, n[tops]), pa.int64()), pa.array(np.append(zero.astype(float), t[tops]), pa.float64())], names=["a", "b", "pairs", "total"])
