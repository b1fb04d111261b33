"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Rows are dealt into shards of a few thousand by a hash. In each shard, greedy searches
propose neighbours of every vector, and robust pruning keeps a diverse few: a candidate
goes when a kept neighbour is closer to it, by the factor alpha, than the vector itself.
Searches begin at the nearest of some pivots that lie as far apart as can be, so that
clusters without edges between them are reached. Every query is searched in every shard
by beam search, and the shards' answers are merged by exact distances. Searches and
pruning run in lock step over many vectors in numpy arrays.

Graphs are built and searched on vectors that are centred and scaled in double precision
shard by shard; answers are compared on the original ones. Equal vectors of a shard are one node, which keeps as many of their smallest ids as an
answer can hold: a large group of copies costs one node and loses no answer.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import pairwise
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, prepare


#: Stands for no entry in a beam: greater than every key.
NONE = np.iinfo(np.int64).max


def squared(x: np.ndarray, nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query (row) to its nodes, from the differences themselves."""
    apart = x[nodes] - queries[:, None, :]
    return np.einsum("ard,ard->ar", apart, apart)


def beam(x: np.ndarray, near: np.ndarray, queries: np.ndarray, pivots: np.ndarray, width: int, starts: int = 8) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Lock-step beam search from the nearest pivots: node ids of the best ``width``, nearest first, ties by number (-1 where fewer), and the expanded (query, node) steps.

    An entry of a beam is one integer of distance bits, node and whether it was expanded,
    so a plain sort keeps the order; float32 distances of 0 and more sort as their bits do.
    """
    n, b = len(x), len(queries)

    def keys(d: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return (d.astype(np.float32).view(np.int32).astype(np.int64) << 32) | (nodes << 1)

    state = np.full((b, width), NONE)
    first = np.sort(keys(squared(x, np.broadcast_to(pivots, (b, len(pivots))), queries), pivots.astype(np.int64)), axis=1)[:, : min(starts, width)]
    state[:, : first.shape[1]] = first
    seen = np.zeros((b, n + 1), dtype=bool)  # the last column takes padding
    seen[np.arange(b)[:, None], (first & 0xFFFFFFFF) >> 1] = True
    seen[:, n] = True
    steps = []
    while True:
        open_ = (state & 1) == 0
        at = open_.argmax(1)
        rows = np.flatnonzero(open_[np.arange(b), at])
        if not rows.size:
            return np.where(state == NONE, -1, (state & 0xFFFFFFFF) >> 1), steps
        nodes = (state[rows, at[rows]] & 0xFFFFFFFF) >> 1
        state[rows, at[rows]] |= 1
        steps.append((rows, nodes))
        nb = near[nodes].astype(np.int64)
        fresh = ~seen[rows[:, None], nb]
        seen[rows[:, None], nb] = True
        new = np.where(fresh, keys(squared(x, np.minimum(nb, n - 1), queries[rows]), nb), NONE)
        state[rows] = np.sort(np.concatenate([state[rows], new], 1), axis=1)[:, :width]


def distinct(candidates: np.ndarray, none: int) -> np.ndarray:
    """Each row's different nodes in order, padded with none."""
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = none
    c = np.sort(c, axis=1)
    return c[:, : max(1, int((c < none).sum(1).max(initial=1)))]


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each point from its candidates (padded with len(x)); padded likewise.

    Distances between candidates come from inner products of their differences to the
    point, which keeps them exact enough in clusters far from the origin.
    """
    n = len(x)
    c = distinct(np.where(candidates == points[:, None], n, candidates), n)
    vec = x[np.minimum(c, n - 1)] - x[points][:, None, :]
    d = np.einsum("bcd,bcd->bc", vec, vec)
    apart = np.matmul(vec, vec.transpose(0, 2, 1))
    apart *= -2
    apart += d[:, :, None]
    apart += d[:, None, :]
    d[c == n] = np.inf
    out = np.full((len(points), degree), n, dtype=np.int64)
    rows = np.arange(len(points))
    left = d.copy()
    for r in range(degree):
        best = left.argmin(1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, r] = c[rows, best][some]
        left[alpha * alpha * apart[rows, best] <= d] = np.inf
        left[rows, best] = np.inf
    return out


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """Numbers of up to ``most`` nodes, the middle one first, then always the one farthest from those before."""
    out = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    away = np.full(len(x), np.inf, dtype=x.dtype)
    while len(out) < min(most, len(x)):
        away = np.minimum(away, ((x - x[out[-1]]) ** 2).sum(1))
        away[out[-1]] = -1.0
        out.append(int(away.argmax()))
    return np.array(out)


def build_graph(x: np.ndarray, degree: int = 24, width: int = 64, alpha: float = 1.2, batch: int = 256, pivots: int = 128, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each node (padded with len(x)) and the pivots, from which searches begin."""
    n = len(x)
    entry = spread(x, pivots)
    rng = np.random.default_rng(seed)
    near = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), n)
    near[near == np.arange(n)[:, None]] = n
    if n <= degree + 1:
        every = np.array([[j for j in range(n) if j != i] for i in range(n)], dtype=np.int64).reshape(n, -1)
        near = np.full((n, degree), n)
        near[:, : every.shape[1]] = every
        return near, entry
    order = rng.permutation(n)
    for at in range(0, n, batch):
        points = order[at : at + batch]
        ids, steps = beam(x, near, x[points], entry, width)
        seen = np.full((len(points), len(steps)), n)
        for k, (rows, nodes) in enumerate(steps):
            seen[rows, k] = nodes
        near[points] = robust_prune(x, points, np.concatenate([seen, np.where(ids < 0, n, ids), near[points]], 1), degree, alpha)
        _link_back(x, near, points, degree, alpha)
    return near, entry


def _link_back(x: np.ndarray, near: np.ndarray, points: np.ndarray, degree: int, slack: float) -> None:
    """Adds the reverse of the points' new edges, all of them, some at a time; nodes that get too many are pruned."""
    n = len(x)
    source, target = np.repeat(points, degree), near[points].ravel()
    source, target = source[target < n], target[target < n]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    ids, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    owner = np.repeat(np.arange(len(ids)), count)
    for at in range(0, int(count.max(initial=0)), degree):
        now = (place >= at) & (place < at + degree)
        some = np.unique(owner[now])
        new = np.full((len(some), degree), n)
        new[np.searchsorted(some, owner[now]), place[now] - at] = source[now]
        nodes = ids[some]
        every = distinct(np.concatenate([near[nodes], new], 1), n)
        fits = (every < n).sum(1) <= degree
        every = np.pad(every, ((0, 0), (0, max(0, degree - every.shape[1]))), constant_values=n)
        near[nodes[fits]] = every[fits, :degree]
        full = np.flatnonzero(~fits)
        for k in range(0, len(full), 512):
            part = full[k : k + 512]
            near[nodes[part]] = robust_prune(x, nodes[part], every[part], degree, slack)


def level(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Middle and size of vectors: (x - middle) / size is about 1 large, wherever and however large the vectors are."""
    top = float(np.abs(x).max()) or 1.0
    middle = np.median(x, axis=0) if len(x) % 2 else np.median(x[:-1], axis=0) if len(x) > 1 else x[0]
    size = float(np.median(np.abs(x / 2 - middle / 2).max(1))) * 2
    return middle, size if 0 < size < np.inf else top


def levelled(x: np.ndarray, middle: np.ndarray, size: float) -> np.ndarray:
    """Vectors for the search in float32; single ones that are far larger than the rest are clipped, so that squares stay finite."""
    return np.clip((x / 2 - middle / 2) / size * 2, -1e15, 1e15).astype(np.float32)


def euclidean(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances in double precision; where squares would overflow or vanish, of scaled differences."""
    with np.errstate(over="ignore"):
        apart = x - q
        d = np.sqrt((apart**2).sum(1))
    off = ~((d > 1e-150) & (d < 1e150)) & (apart != 0).any(1)
    if off.any():
        half = x[off] / 2 - q / 2
        top = np.abs(half).max(1)
        d[off] = np.sqrt(((half / top[:, None]) ** 2).sum(1)) * top * 2
    return d


def _pack(vectors: np.ndarray, ids: np.ndarray, keep: int) -> dict:  # type: ignore[type-arg]
    """The different vectors, in the order of their smallest ids, with up to ``keep`` of their smallest ids each."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    _, first, owner = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    held: list[list[int]] = [[] for _ in first]
    for o, i in zip(rank[owner.ravel()].tolist(), ids.tolist(), strict=True):
        if len(held[o]) < keep and (not held[o] or held[o][-1] != i):
            held[o].append(i)
    return {"x": vectors[np.sort(first)], "ids": held}


def make_index(vectors: np.ndarray, ids: np.ndarray, keep: int, degree: int = 24, width: int = 64, alpha: float = 1.2) -> dict:  # type: ignore[type-arg]
    index = _pack(vectors, ids, keep)
    index["middle"], index["size"] = level(index["x"])
    near, index["pivots"] = build_graph(levelled(index["x"], index["middle"], index["size"]), degree, width, alpha)
    index["near"] = near.astype(np.int32)
    return index


def search_shard(index: dict, queries: np.ndarray, query_ids: list[int], k: int, width: int) -> list[tuple[int, int, float]]:  # type: ignore[type-arg]
    """(query, row, distance) of the k nearest rows of a shard for each query, by exact distances of the beam's nodes.

    Where a beam ends with fewer rows than the shard has, the whole shard is compared.
    """
    x, out = index["x"], []
    if "level" not in index:
        index["level"] = levelled(x, index["middle"], index["size"])
    ids, _ = beam(index["level"], index["near"], levelled(queries, index["middle"], index["size"]), index["pivots"], width)
    for q, row, own in zip(queries, ids, query_ids, strict=True):
        nodes = row[row >= 0]
        if nodes.size < min(width, len(x)) and sum(len(index["ids"][j]) for j in nodes) <= k:
            nodes = np.arange(len(x))
        d = euclidean(x[nodes], q)
        best: list[tuple[float, int]] = []
        for j in np.argsort(d, kind="stable"):
            if len(best) >= k and d[j] > best[-1][0]:
                break
            best = sorted(best + [(float(d[j]), i) for i in index["ids"][nodes[j]] if i != own])[:k]
        out += [(own, i, s) for s, i in best]
    return out


def nearest_neighbours(
    vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, block: int = 131_072, degree: int = 24, width: int = 96, alpha: float = 1.2
) -> DataFrame:  # noqa: ANN001
    """The k nearest rows of each query row, by Euclidean distance: (query_id, rank, vec_id, score).

    is_query: a condition on the id column. Every row but the query's own is a candidate;
    ties go to the smaller id. Vectors that are null, empty, zero, or hold null or
    non-finite components, and rows without id, take no part; repeated rows count once; of
    an id with several vectors the nearest counts. Only vectors of one length are
    compared. Other columns are ignored. Empty tables give an empty result.

    A graph of shard_rows rows is made by one task and checkpointed. Queries are streamed past
    each graph, a batch at a time: a graph is read once for every ``block`` queries. The
    search looks into every shard, so its work is queries times shards; larger shards make
    it less, as a search in a graph grows only slowly with its size, and need more memory.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = rows.where(~F.exists(v, bad) & F.exists(v, lambda c: c != 0)).distinct()
    rows = durable(rows)
    n = rows.count()
    shards, blocks = max(1, ceil(n / shard_rows)), max(1, ceil(rows.where(is_query(F.col("id"))).count() / block))
    h = F.xxhash64("id", "v")
    dealt = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(h, F.lit(shards)).cast("int").alias("shard"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        index = make_index(np.array(pdf["v"].tolist(), dtype=np.float64), pdf["id"].to_numpy(), k + 1, degree, min(width, 64), alpha)
        return pd.DataFrame({"dim": [int(pdf["dim"][0])], "shard": [int(pdf["shard"][0])], "data": [pickle.dumps(index)]})

    graphs = durable(dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, data binary"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    keys = ("dim", "shard", "block")
    left = graphs.withColumn("block", every(blocks)).select(*keys, "data", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"))
    asked = dealt.where(is_query(F.col("id"))).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).drop("shard").withColumn("shard", every(shards))
    work = left.unionByName(asked.select(*keys, F.lit(None).cast("binary").alias("data"), "id", "v"))
    work = work.repartition(shards * blocks, *keys).sortWithinPartitions(*keys, F.col("data").isNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, now = None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
                if tuple(key[:, a].tolist()) != now:
                    index, now = None, tuple(key[:, a].tolist())
                if batch.column(3)[a].is_valid:
                    index, a = pickle.loads(batch.column(3)[a].as_py()), a + 1
                for at in range(a, b if index is not None else a, 256):
                    part = batch.slice(at, min(256, b - at))
                    q = part.column(5).flatten().to_numpy().reshape(part.num_rows, -1)
                    found = search_shard(index, q, part.column(4).to_pylist(), k, width)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True) if found else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    found = work.mapInArrow(answer, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
