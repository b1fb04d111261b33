"""Toxicity by class-conditional Kneser-Ney models.

Two word-bigram models, of toxic and of ordinary labelled documents, are smoothed by
interpolated Kneser-Ney with power-law discounts: a count n loses n ** power, a count of 1
all. What the discounts take of a class's bigrams goes to shared bigram counts; what they
take of these goes to the class's continuation counts (after how many different words a
word comes); and what they take of these goes to shared continuation counts. Shared counts
are, as in Kneser-Ney smoothing, what the discounts take of both classes' counts. So an
expression that is rare is judged by the shared counts, alike in both models, and both
models leave the same mass to the shared continuation counts.

A text is compared by length-normalised differences of its two log-likelihoods: over
the whole text, and as the highest value over its passages of ``PASSAGES`` words, because a
long text can be toxic in one place. A logistic regression whose weights are all positive,
fitted on labelled documents that the models have not seen, turns these
differences into a score from 0 to 1.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fit_in_one_task, folded_crc, prepare, words

#: Lengths of the passages that are compared on their own, in words.
PASSAGES = (1, 2, 8, 32)
FIGURES = 2 + len(PASSAGES)
UNKNOWN = 0
#: A count n of a word, or of a bigram, is discounted by n to these powers.
WORD_POWER, PAIR_POWER = 0.5, 0.85
#: Words in a row that must have come before for each of them to be a repetition.
CHAIN = 3


def taken(counts: np.ndarray, power: float) -> np.ndarray:
    """What the discount takes of each count, by a power law: a count of 1 whole, of larger ones a smaller share."""
    return counts**power


@dataclass
class ToxicityModel:
    """Vocabulary ids start at 1; 0 is any other word. Bigram keys are left * size + right, sorted."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    unigram: np.ndarray = field(default_factory=lambda: np.ones((2, 1)))
    backoff: np.ndarray = field(default_factory=lambda: np.ones((2, 1)))
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    mass: np.ndarray = field(default_factory=lambda: np.empty((2, 0)))
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(FIGURES))

    def differences(self, text: str | None) -> np.ndarray:
        """Of each word, its log-probability in the toxic model less that in the ordinary one."""
        get = self.vocabulary.get
        ids = np.array([get(w, UNKNOWN) for w in words(text)], dtype=np.int64)
        if not ids.size:
            return np.empty(0)
        left = np.concatenate([[UNKNOWN], ids[:-1]])
        p = self.backoff[:, left] * self.unigram[:, ids]
        if self.keys.size:
            key = left * self.unigram.shape[1] + ids
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            hit = self.keys[at] == key
            p[:, hit] += self.mass[:, at[hit]]
        return np.log(p[1]) - np.log(p[0])

    def figures(self, text: str | None) -> np.ndarray:
        """Constant, length-normalised difference of the whole text, and of its strongest passage of each length."""
        d = self.differences(text)
        out = np.zeros(FIGURES)
        out[0] = 1.0
        if d.size:
            out[1] = d.mean()
            total = np.concatenate([[0.0], np.cumsum(d)])
            for k, n in enumerate(PASSAGES, 2):
                m = min(n, d.size)
                out[k] = (total[m:] - total[:-m]).max() / n
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.figures(text) @ self.coefficients, -35, 35))))


def _chains(ids: np.ndarray) -> np.ndarray:
    """For each word, a hash of it and the ``CHAIN`` - 1 words before it; 0 where there are fewer, unless the text ends there."""
    out = np.zeros(ids.size, dtype=np.uint64)
    for k in range(min(CHAIN, ids.size)):
        out[k:] += (ids[: ids.size - k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 ** (k + 1) & (1 << 64) - 1)
    out[: min(CHAIN, ids.size) - 1] = 0
    return out


def _fresh(chain: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of each word, if all chains that hold it come here for the first time; after counts the words behind it in its document.

    The chains that end at later words count too, or else the first words of a copied passage
    would pass as new wherever the words before the passage differ.
    """
    new = chain == 0
    new[np.unique(chain, return_index=True)[1]] = True
    out = new.copy()
    for k in range(1, min(CHAIN, chain.size)):
        out[:-k] &= new[k:] | (after[:-k] < k)
    return out


def fit_models(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """The two models; words seen once in all are unknown, and a passage that documents of a class share counts once in it.

    With c the counts of a class, b those of bigrams, f those of words (different words before
    it), n sums over the second word, d a discount and s sums of d over both classes:
    P(w | v) = (b_c - d(b_c)) / n_c + d_c / n_c * ((s - d(s)) / n_s + d_s / n_s * U_c(w)) and
    U_c(w) = (1 - g) * (f_c - d(f_c)) / sum + g * s(w) / sum, with one g for both classes.
    """
    lists = [[words(t) for t in texts] for texts in (ordinary, toxic)]
    seen = Counter(w for texts in lists for ws in texts for w in ws)
    vocabulary = {w: i for i, w in enumerate((w for w in sorted(seen) if seen[w] > 1), 1)}
    size = len(vocabulary) + 1
    bigrams = []
    for texts in lists:
        ids = [np.array([vocabulary.get(w, UNKNOWN) for w in ws], dtype=np.int64) for ws in texts if ws]
        key = np.concatenate([np.concatenate([[UNKNOWN], x[:-1]]) * size + x for x in ids] or [np.empty(0, dtype=np.int64)])
        chain = np.concatenate([_chains(x) for x in ids] or [np.empty(0, dtype=np.uint64)])
        after = np.concatenate([np.arange(x.size)[::-1] for x in ids] or [np.empty(0, dtype=np.int64)])
        bigrams.append(np.unique(key[_fresh(chain, after)], return_counts=True))

    # Words: continuation counts, after how many different words a word comes; the shared counts are what the discounts take of both classes.
    follows = [np.bincount(k % size, minlength=size).astype(float) for k, _ in bigrams]
    shared = sum(taken(f, WORD_POWER) for f in follows)
    shared = np.maximum(shared, 1.0) / np.maximum(shared, 1.0).sum()
    # Both models leave the same mass to the shared counts, so that a word which neither knows speaks for neither.
    to_shared = max((taken(f, WORD_POWER).sum() / f.sum() for f in follows if f.sum()), default=1.0)
    unigram = np.empty((2, size))
    for c, f in enumerate(follows):
        own = f - taken(f, WORD_POWER)
        unigram[c] = to_shared * shared + (1 - to_shared) * own / own.sum() if own.sum() else shared

    # Bigrams: a class's own, then the shared ones, then the class's words.
    keys, at = np.unique(np.concatenate([k for k, _ in bigrams]), return_inverse=True)
    counts = np.zeros((3, keys.size))
    for c, part in enumerate(np.split(at, [bigrams[0][0].size])):
        counts[c, part] = bigrams[c][1]
    counts[2] = taken(counts[0], PAIR_POWER) + taken(counts[1], PAIR_POWER)
    n = np.array([np.bincount(keys // size, weights=k, minlength=size) for k in counts])
    left = np.array([np.bincount(keys // size, weights=taken(k, PAIR_POWER), minlength=size) for k in counts])
    left = np.where(n > 0, left / np.maximum(n, 1), 1.0)
    mass = (counts - taken(counts, PAIR_POWER)) / np.maximum(n, 1)[:, keys // size]
    table = mass[:2] + left[:2, keys // size] * mass[2]
    backoff = left[:2] * left[2]
    some = (table > 0).any(0)
    often, table = keys[some], table[:, some]
    return ToxicityModel(vocabulary, unigram, backoff, often, table)


def calibrate(model: ToxicityModel, texts: list[str], toxic: np.ndarray, ridge: float = 0.0003, least: float = 0.05) -> None:
    """Logistic regression of the labels on the figures. Every difference keeps a positive weight."""
    model.coefficients = np.zeros(FIGURES)
    model.coefficients[1] = 1.0
    if not len(texts) or len(set(toxic.tolist())) < 2:
        return
    x = np.array([model.figures(t) for t in texts])
    scale = np.concatenate([[1.0], x[:, 1:].std(0) + 1e-9])
    z, y = x / scale, toxic.astype(float)
    weight = np.full(y.size, 1 / y.size)
    keep = np.concatenate([[1e-9], np.full(FIGURES - 1, ridge)])
    start = np.concatenate([[0.0], np.full(FIGURES - 1, 0.1)])

    def loss(b: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ b)) + keep @ (b * b) / 2)

    # Newton steps on the weights that are free: at their least, those that want to grow.
    b = start
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        grad = z.T @ (weight * (p - y)) + keep * b
        free = (b > least) | (grad < 0) | (np.arange(FIGURES) == 0)
        hess = (z[:, free] * (weight * p * (1 - p))[:, None]).T @ z[:, free] + np.diag(keep[free] + 1e-9)
        step = np.zeros(FIGURES)
        step[free] = np.linalg.solve(hess, grad[free])
        rate, now = 1.0, loss(b)
        while True:
            new = b - rate * step
            new[1:] = np.maximum(new[1:], least)
            if loss(new) <= now or rate < 1e-4:
                break
            rate /= 2
        moved, b = np.abs(new - b).max(), new
        if moved < 1e-6:
            break
    model.coefficients = b / scale


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 3000, most_bytes: int = 48_000_000) -> ToxicityModel:
    """Fit on a bounded sample of labelled documents outside the held-out fold (crc32 of the id mod 5 is 0).

    Of each class, the most_rows documents of smallest hash, and of these, in that order,
    each that still fits in most_bytes of text, are fitted in one task; the driver gets the
    model only. Folds 1 to 3 train the
    language models, fold 4 the calibration. Ids labelled both ways count as toxic; null
    labels are ignored. With labels of one class only, scores rest on the plain
    difference; without labels all scores are 0.5.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("toxic")).na.drop().where(folded_crc("key") != 0)
    known = known.groupBy("key").agg(F.max("toxic").alias("toxic"))
    part = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("key"), "key").limit(most_rows) for c in (0, 1)]
    chosen = part[0].unionByName(part[1])
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key").where(F.octet_length("text") > 0)
    rows = rows.select("toxic", "text", folded_crc("key").alias("fold"), F.xxhash64("key").alias("h"))

    def fit(batches: Iterable[pa.RecordBatch]) -> ToxicityModel:
        sample: dict[tuple[bool, int], list[str]] = defaultdict(list)
        size = 0
        for b in batches:
            for y, text, fold in zip(*(b.column(k).to_pylist() for k in ("toxic", "text", "fold")), strict=True):
                n = len(text.encode())
                if size + n <= most_bytes:
                    size += n
                    sample[fold == 4, y].append(text)
        model = fit_models(sample[False, 1], sample[False, 0])
        rest = sample[True, 0] + sample[True, 1]
        calibrate(model, rest, np.array([0] * len(sample[True, 0]) + [1] * len(sample[True, 1])))
        return model

    sample = rows.orderBy("h").limit(2 * most_rows).repartition(1).sortWithinPartitions("h", "text")
    return fit_in_one_task(sample, fit)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All columns of docs and score, a double from 0 to 1; higher means toxic is likelier.

    A narrow map over whole texts; the model's size follows the training sample's bound.
    Null and empty texts get the score of a text without evidence; repeated rows are
    kept; a column named score is replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.drop("score")
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([shared.value.score(t.as_py()) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, "score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
