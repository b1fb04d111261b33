"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs with at most e edits, cut into e + 1 pieces, has one piece that
occurs unchanged. All pieces of all items form one automaton; it runs once over each
whole document, and every hit opens a window that Myers' bit-parallel algorithm
verifies: the smallest edit distance between the item and any stretch of the window.

Texts are compared as lower-cased word characters with single spaces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import prepare, words

#: Edits allowed for each character of an item.
ERROR_RATE = 1 / 16
#: Shorter items must occur unchanged, as whole words.
LEAST_CHARS = 24
#: Items of one automaton, in bytes of text.
MOST_BYTES = 4_000_000


def normal(text: str | None) -> str:
    return " ".join(words(text))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def myers(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a stretch of the text, and the first end of such a stretch."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = pattern_masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j
    return best, end


@dataclass(frozen=True)
class Item:
    key: object
    text: str
    budget: int
    forward: dict[str, int]
    backward: dict[str, int]


class ItemMatcher:
    """The pieces of a block of items; finds items in documents."""

    def __init__(self, items: list[tuple[object, str | None]], error_rate: float = ERROR_RATE):
        self.items: list[Item] = []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for key, raw in items:
            text = normal(raw)
            if not text:
                continue
            budget = int(len(text) * error_rate) if len(text) >= LEAST_CHARS else 0
            if len(text) < LEAST_CHARS:
                text = f" {text} "
            k = len(self.items)
            self.items.append(Item(key, text, budget, masks(text), masks(text[::-1])))
            cuts = [i * len(text) // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places[text[a:b]].append((k, a))
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, (len(piece), where))
        if places:
            self.pieces.make_automaton()

    def find(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item key, distance, start, end) of the best occurrence of each item within its budget; places count in the compared text."""
        page = normal(text)
        if not self.items or not page:
            return []
        padded = f" {page} "
        opened: dict[int, list[int]] = defaultdict(list)
        for end, (size, where) in self.pieces.iter(padded):
            for k, offset in where:
                opened[k].append(end - size + 1 - offset)
        out = []
        for k, starts in sorted(opened.items()):
            item = self.items[k]
            best: tuple[int, int, int] | None = None
            for lo, hi in self._windows(sorted(set(starts)), item, len(padded)):
                distance, end = myers(item.forward, len(item.text), padded[lo:hi])
                if distance <= item.budget and (best is None or distance < best[0]):
                    reach = padded[max(lo, lo + end - len(item.text) - item.budget) : lo + end]
                    _, back = myers(item.backward, len(item.text), reach[::-1])
                    best = distance, max(0, lo + end - back - 1), min(len(page), lo + end - 1)
            if best is not None:
                out.append((item.key, *best))
        return out

    @staticmethod
    def _windows(starts: list[int], item: Item, size: int) -> Iterator[tuple[int, int]]:
        """Stretches that hold every occurrence proposed by a hit, joined where they overlap."""
        now: list[int] | None = None
        for s in starts:
            lo, hi = max(0, s - item.budget), min(size, s + len(item.text) + item.budget)
            if now is not None and lo <= now[1]:
                now[1] = max(now[1], hi)
                continue
            if now is not None:
                yield now[0], now[1]
            now = [lo, hi]
        if now is not None:
            yield now[0], now[1]


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All columns of docs and hits: array of (item_id, distance, start, end), one for each item found.

    A narrow map over whole documents. Items are broadcast in blocks of about most_bytes
    of text, as many blocks as the table needs, one pass each. Null and wordless texts
    and items match nothing; repeated rows are kept, repeated items count once; a column
    named hits is replaced. Empty tables give no hits.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = items.select(F.col(item_id).alias("key"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(total / most_bytes))
    kind = known.schema["key"].dataType
    hit = StructType([StructField("item_id", kind), StructField("distance", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    out = docs.drop("hits")
    at = out.columns.index(text_col)
    for block in range(blocks):
        part = known.where(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == block) if blocks > 1 else known
        shared = spark.sparkContext.broadcast(sorted(((r["key"], r["text"]) for r in part.collect()), key=lambda r: (str(r[0]), r[1])))
        schema = StructType([*[f for f in out.schema.fields if f.name != "hits"], StructField("hits", ArrayType(hit))])
        more = "hits" in out.columns

        def run(batches: Iterator[pa.RecordBatch], shared=shared, schema=schema, more: bool = more) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            matcher = ItemMatcher(shared.value, error_rate)
            for b in batches:
                before = b.column(b.num_columns - 1).to_pylist() if more else [[]] * b.num_rows
                found = []
                for t, old in zip(b.column(at).to_pylist(), before, strict=True):
                    by_item = {x["item_id"]: x for x in old}
                    for key, d, s, e in matcher.find(t):
                        if key not in by_item or d < by_item[key]["distance"]:
                            by_item[key] = {"item_id": key, "distance": d, "start": s, "end": e}
                    found.append(list(by_item.values()))
                columns = b.columns[:-1] if more else b.columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _arrow(schema))], names=schema.names)

        out = out.mapInArrow(run, schema)
    return out


def _arrow(schema: StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema["hits"].dataType)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:  # noqa: ANN003
    """One row for each document and item found in it: (id, item_id, distance, start, end)."""
    found = find_items(docs.select(F.col(id_col), F.col(options.get("text_col", "text"))), items, **options)
    return found.select(F.col(id_col), F.explode("hits").alias("h")).select(id_col, "h.item_id", "h.distance", "h.start", "h.end")
