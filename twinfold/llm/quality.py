"""Ordinal cumulative-link regression of graded ratings on hashed text.

P(grade <= k) = sigmoid(theta_k - s), with one score s = w . x for all grades and
ordered thresholds theta. x holds the relative frequencies of hashed byte 2-grams and
4-grams of the whole text. The expected grade and the probability of the top grades
follow from s and theta.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fit_in_one_task, folded_crc, prepare

BITS = 12
#: Bytes worked on at once; long texts are taken in pieces, all of them.
PIECE = 1 << 20


def hashed_grams(data: np.ndarray, size: int) -> np.ndarray:
    """Bucket of each byte gram of the given size; 2-grams and 4-grams share the buckets."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    code = np.zeros(n, dtype=np.uint32)
    for k in range(size):
        code |= data[k : n + k].astype(np.uint32) << np.uint32(8 * k)
    return (code * np.uint32(2654435761 + 2 * size)) >> np.uint32(32 - BITS)


def _pieces(data: bytes) -> Iterator[np.ndarray]:
    """The buckets of all grams of a text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    for size in (2, 4):
        for at in range(0, max(1, len(raw) - size + 1), PIECE):
            yield hashed_grams(raw[at : at + PIECE + size - 1], size)


def features(text: str | None) -> np.ndarray:
    out = np.zeros(1 << BITS)
    for h in _pieces((text or "").encode()):
        out += np.bincount(h, minlength=1 << BITS)
    return (out / max(1.0, out.sum())).astype(np.float32)


@dataclass
class OrdinalModel:
    """weights: by bucket; thresholds: one less than grades; grades: the rating values in order."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for h in _pieces((text or "").encode()):
            total, n = total + float(self.weights[h].sum()), n + len(h)
        return total / n if n else 0.0

    def above(self, score: float) -> np.ndarray:
        """P(grade > grades[k]) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))

    def grade(self, text: str | None) -> tuple[float | None, float]:
        """Expected grade and probability of the top grade. Empty texts get the lowest grade and probability 0; without any grade known, other texts get no grade and probability 1."""
        if not self.grades:
            return None, 1.0 if text else 0.0
        if not text:
            return float(self.grades[0]), 0.0
        up = self.above(self.score(text))
        steps = np.diff(np.array(self.grades, dtype=float))
        return float(self.grades[0] + (steps * up).sum()), float(up[-1]) if len(up) else 1.0


def fit_ordinal(x: np.ndarray, rating: np.ndarray, rounds: int = 250, rate: float = 0.05, ridge: float = 1e-3) -> OrdinalModel:
    """Full-batch Adam on the negative log-likelihood; classes weigh alike in the score, and thresholds stay ordered."""
    grades = sorted({int(r) for r in rating})
    dims = x.shape[1] if x.ndim == 2 else 1 << BITS
    if len(grades) < 2:
        return OrdinalModel(np.zeros(dims), np.empty(0), grades)
    y = np.searchsorted(grades, rating)
    k = len(grades)
    middle, scale = x.mean(0), x.std(0) + np.float32(1e-4)
    z = (x - middle) / scale
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y)
    raw = np.log(share / (1 - share))  # thresholds of the constant model
    raw = np.concatenate([raw[:1], np.log(np.maximum(np.diff(raw), 1e-3))])
    w = np.zeros(dims, dtype=np.float32)
    state = [np.zeros(dims + k - 1), np.zeros(dims + k - 1)]
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -60, 60)))
    for step in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        s = z @ w
        full = np.concatenate([[-1e9], theta, [1e9]])
        hi, lo = sig(full[y + 1] - s), sig(full[y] - s)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        grad_s = (dhi - dlo) / p / len(y)  # of -log p by s
        gw = z.T @ grad_s.astype(np.float32) + ridge * w
        grad_t = np.zeros(k + 1)
        np.add.at(grad_t, y + 1, -dhi / p / len(y))
        np.add.at(grad_t, y, dlo / p / len(y))
        tail = np.cumsum(grad_t[1:k][::-1])[::-1]
        graw = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
        g = np.concatenate([gw, graw])
        state = [0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g]
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w = (w - 0.2 * move[:dims]).astype(np.float32)
        raw = raw - move[dims:]
    theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
    weights = w / scale
    return OrdinalModel(weights.astype(np.float64), theta + float(middle @ weights), grades)


def train_quality(docs: DataFrame, labels: DataFrame, rating: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = 4000) -> OrdinalModel:
    """Fit on at most ``most_rows`` labelled documents, those with the smallest hashes, outside the held-out fold.

    The sample, most_rows vectors of 4096 floats and so 64 MB at most, is fitted in one task;
    the driver gets the model only.
    Labels of one id that disagree count with their highest rating; null ratings are
    ignored. Rows are taken and fitted in the order of their hashes, so reruns agree. Without two different ratings the model has no thresholds and rejects
    only empty texts.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.select(F.col(id_col).alias("key"), F.col(rating).cast("int").alias("rating")).na.drop().where(folded_crc("key") != 0)
    chosen = known.groupBy("key").agg(F.max("rating").alias("rating")).orderBy(F.xxhash64("key"), "key").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key").select("rating", "text", F.xxhash64("key").alias("h"), F.xxhash64("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("rating"), b.column("h"), b.column("t"), pa.array(x, pa.binary())], names=["rating", "h", "t", "x"])

    def fit(batches: Iterable[pa.RecordBatch]) -> OrdinalModel:
        held = [b for b in batches if b.num_rows]
        x = np.frombuffer(b"".join(v.as_buffer() for b in held for v in b.column("x")), dtype=np.float32).reshape(-1, 1 << BITS)
        return fit_ordinal(x, np.concatenate([b.column("rating").to_numpy() for b in held] or [np.empty(0)]))

    sample = rows.mapInArrow(run, "rating int, h long, t long, x binary").orderBy("h", "t").limit(most_rows)
    return fit_in_one_task(sample.repartition(1).sortWithinPartitions("h", "t"), fit)


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """All columns of docs and expected_grade, tail_prob (of the top grade) and selected (tail_prob >= keep_at).

    A narrow map over whole texts; the model (32 KB) is broadcast. Null and empty texts
    get the lowest grade and tail_prob 0; repeated rows are kept; columns of docs named
    like an added one are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    kept = docs.drop("expected_grade", "tail_prob", "selected")
    at = kept.columns.index(text_col)
    schema = StructType([*kept.schema.fields, StructField("expected_grade", DoubleType()), StructField("tail_prob", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grades = [shared.value.grade(t.as_py()) for t in b.column(at)]
            more = [pa.array([g[k] for g in grades], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "expected_grade", "tail_prob"])

    return kept.mapInArrow(run, schema).withColumn("selected", F.col("tail_prob") >= keep_at)
