"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged numpy array of symbol ids. Every round looks up
the merge rank of all neighbouring pairs at once, finds the lowest rank of each
sequence, and applies that pair at all its places in all sequences together. What
survives when no pair has a rank is the number of tokens.

Applying a pair at all its places at once equals the one-by-one order as long as
each merge makes a symbol that no other merge makes: a pair holding the new symbol
then always has a later rank. ``MergeTable`` checks this; with a table that breaks
it, only the leftmost place of each sequence is merged in a round.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Fixed value: how byte-level tokenizers of this family split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class MergeTable:
    """Merges as arrays: key (left * size + right) and merged symbol, in order of rank."""

    def __init__(self, vocab: dict[str, int], merges: list, special: list[str] = ()):  # type: ignore[assignment]
        self.size = max(vocab.values(), default=0) + 1
        self.byte_id = np.array([vocab[c] for c in byte_characters()], dtype=np.int64)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.keys, self.made = keys, made
        self.slots: list[np.ndarray] = []  # open tables of ranks; a key found in none has no merge
        left = np.arange(len(keys))
        while left.size:
            table = np.full(1 << 20, -1, dtype=np.int32)
            table[self._slot(keys[left], len(self.slots))] = left
            self.slots.append(table)
            left = left[table[self._slot(keys[left], len(self.slots) - 1)] != left]
        self.together = len(np.unique(made)) == len(made) and not np.isin(made, self.byte_id).any()
        self.special = [s for s in special if s]

    @staticmethod
    def _slot(keys: np.ndarray, table: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * table * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(44)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Merge rank of each key; NONE where there is no merge."""
        out = np.full(keys.size, NONE)
        for k, table in enumerate(self.slots):
            at = table[self._slot(keys, k)]
            found = (at >= 0) & (self.keys[at] == keys)
            out[found] = at[found]
        return out

    @classmethod
    def from_json(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if data["model"]["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data["normalizer"]:
            raise ValueError("only byte-level BPE files without a normalizer are read")
        return cls(data["model"]["vocab"], data["model"]["merges"], [t["content"] for t in data["added_tokens"]])

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each piece when no merge applies any more."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out = lengths.copy()
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while symbols.size > 1 and self.keys.size:
            key = symbols[:-1] * self.size + symbols[1:]
            rank = np.append(np.where(owner[:-1] == owner[1:], self.rank(key), NONE), NONE)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            span = np.diff(np.append(first, symbols.size))
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == NONE
            out[owner[first[done]]] = span[done]
            place = np.flatnonzero((rank == np.repeat(lowest, span)) & (rank != NONE))
            if not place.size:
                return out
            if self.together:  # of overlapping places, as in a run of one symbol, every second one counts
                run = np.append(True, np.diff(place) != 1)
                start = place[np.maximum.accumulate(np.where(run, np.arange(place.size), 0))]
                place = place[(place - start) % 2 == 0]
            else:
                place = place[np.append(True, owner[place][1:] != owner[place][:-1])]
            symbols[place] = self.made[rank[place]]
            keep = ~np.repeat(done, span)
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if symbols.size:
            ids, n = np.unique(owner, return_counts=True)
            out[ids] = n
        return out


class TokenCounter:
    """Counts tokens of texts; remembers the counts of pre-tokens up to a bound."""

    def __init__(self, table: MergeTable, remember: int = 400_000):
        self.table, self.remember, self.known = table, remember, {}
        self.find = regex.compile(SPLIT).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None

    def count(self, texts: list[str | None], together: int = 2_000_000) -> list[int]:
        """Tokens of each text; new pre-tokens of about ``together`` characters are merged in one go."""
        out: list[int] = []
        held: list[tuple[int, list[list[str]]]] = []
        size = 0
        for text in texts:
            parts = list(self._parts(text or ""))
            held.append((parts.count(None), [self.find(p) for p in parts if p]))
            size += len(text or "")
            if size >= together:
                out += self._flush(held)
                held, size = [], 0
        return out + self._flush(held)

    def _flush(self, held: list[tuple[int, list[list[str]]]]) -> list[int]:
        if len(self.known) > self.remember:
            self.known.clear()
        new: set[str] = set()
        for _, lists in held:
            for pieces in lists:
                new.update(pieces)
        fresh = [p for p in new if p not in self.known]
        self.known.update(zip(fresh, self.table.counts([p.encode() for p in fresh]).tolist(), strict=True))
        return [n + sum(sum(map(self.known.__getitem__, pieces)) for pieces in lists) for n, lists in held]

    def _parts(self, text: str) -> Iterator[str | None]:
        """Plain stretches of a text; None for each special token between them."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield text[at : m.start()]
            yield None
            at = m.end()
        yield text[at:]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every whole text: (id, n_bytes, n_tokens, over_limit).

    vocabulary: path of a byte-level BPE file, read on the driver; its arrays (a few
    MB, as many entries as the file has merges) are broadcast. No shuffle. Null texts
    and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are kept;
    other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(MergeTable.from_json(vocabulary))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(shared.value)
        for b in batches:
            n = pa.array(counter.count(b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_bytes"), n], names=["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"key {kind.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
