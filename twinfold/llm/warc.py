"""Merkle fixity audit of WARC archives.

Each site hashes its own records and, bottom-up, ordered ranges of offsets: a range of
``SPAN`` bytes at the lowest level, ``FANOUT`` ranges joined at each level above. A
range is fixed by offset and not by record number, so a lost record does not shift
the others. The audit compares the roots of two replicas and descends, level by level,
only into ranges whose hashes differ, down to the damaged records.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, prepare

SPAN = 65_536
FANOUT = 16
#: Stands for the digest of a null payload.
ABSENT = "absent"


@dataclass
class MerkleTree:
    """levels[0]: records (archive, pos, hash, length); then ranges (archive, pos, hash), pos being the number of the range."""

    levels: list[DataFrame]
    roots: DataFrame


def record_bytes(record_id: Column, uri: Column, payload: Column) -> Column:
    """A WARC response record as text; nulls are written as empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def digest(payload: Column) -> Column:
    return F.coalesce(F.sha2(payload, 256), F.lit(ABSENT))


def lay_out(records: DataFrame, archive: str = "archive", order: list[str] = ("id",), length: str = "length") -> DataFrame:  # type: ignore[assignment]
    """Adds ``offset``: the bytes before a record in its archive. An archive file is bounded in size, and so is this window.

    A null archive is one of its own; null lengths count as 0; rows that tie in the order
    get places by chance; an empty table gives an empty one.
    """
    w = Window.partitionBy(archive).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def tree_leaves(records: DataFrame, archive: str = "archive", offset: str = "offset", digest_col: str = "digest", length: str = "length") -> DataFrame:
    """The lowest level of a tree, written once: (archive, pos, hash, length). See ``merkle_tree`` for nulls and ties."""
    rows = records.select(F.col(archive).cast("string").alias("archive"), F.coalesce(F.col(offset), F.lit(-1)).cast("long").alias("pos"), F.coalesce(F.col(digest_col), F.lit(ABSENT)).alias("hash"), F.col(length).cast("long").alias("length"))
    many = F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.min("hash"), F.max("hash"), F.sum(F.xxhash64("hash").cast("decimal(38,0)"))), 256)
    return durable(rows.groupBy("archive", "pos").agg(F.when(F.count(F.lit(1)) == 1, F.min("hash")).otherwise(many).alias("hash"), F.max("length").alias("length")))


def grow(leaves: DataFrame, depth: int) -> MerkleTree:
    """The tree over its leaves. Every level is written, as the audit reads each of them more than once."""
    levels = [leaves]
    for k in range(1, depth + 1):
        levels.append(durable(_ranges(levels[-1], F.floor(F.col("pos") / (SPAN if k == 1 else FANOUT)).cast("long"))))
    return MerkleTree(levels, durable(_ranges(levels[-1], F.lit(0).cast("long")).select("archive", "hash")))


def merkle_tree(records: DataFrame, depth: int | None = None, archive: str = "archive", offset: str = "offset", digest_col: str = "digest", length: str = "length") -> MerkleTree:
    """The tree over (archive, offset, digest, length) rows; digest is hashed payload, see ``digest``.

    Groups are offset ranges and hold at most SPAN records or FANOUT hashes, however
    large an archive is. Several records at one offset become one leaf, whose hash
    covers their number and digests; a null archive is a name of its own, null offsets
    come before 0. Other columns are ignored. An empty table gives a tree without roots.
    """
    leaves = tree_leaves(records, archive, offset, digest_col, length)
    return grow(leaves, tree_depth(leaves) if depth is None else depth)


def tree_depth(leaves: DataFrame) -> int:
    """Levels of ranges until one range holds all offsets."""
    top = leaves.agg(F.max("pos")).first()[0] or 0
    depth, width = 1, SPAN
    while width <= top:
        depth, width = depth + 1, width * FANOUT
    return depth


def _ranges(below: DataFrame, number: Column) -> DataFrame:
    """One level up: the hash of a range covers its children's numbers and hashes, in order."""
    child = F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("hash"))
    inside = F.transform(F.sort_array(F.collect_list(F.struct("pos", child.alias("child")))), lambda x: x["child"])
    return below.groupBy("archive", number.alias("number")).agg(F.sha2(F.concat_ws("|", inside), 256).alias("hash")).select("archive", F.col("number").alias("pos"), "hash")


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two levels, null-safe in the archive; rows whose hashes differ."""
    b = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    on = a["archive"].eqNullSafe(b["archive_b"])
    for k in keys:
        on = on & (a[k] == b[f"{k}_b"])
    joined = a.join(b, on, "full_outer").where(~F.col("hash").eqNullSafe(F.col("hash_b")))
    archive = F.when(F.col("hash").isNull(), F.col("archive_b")).otherwise(F.col("archive"))
    return joined.select(archive.alias("archive"), *[F.coalesce(k, f"{k}_b").alias(k) for k in keys], F.col("hash").alias("hash_a"), F.col("hash_b"), *([F.coalesce("length", "length_b").alias("length")] if "length" in a.columns else []))


def audit(a: MerkleTree, b: MerkleTree) -> DataFrame:
    """Damaged records: (archive, offset, length, status), status corrupt, missing (in b) or extra (in b).

    Both trees must have the same depth. Only children of differing ranges are compared,
    so what is joined and shuffled follows the damage; the hashes of each level are read whole.
    """
    if len(a.levels) != len(b.levels):
        raise ValueError("trees of different depth")
    suspects = durable(_differing(a.roots, b.roots, []).select("archive", F.lit(0).cast("long").alias("pos")))
    for k in range(len(a.levels) - 1, -1, -1):
        width = None if k == len(a.levels) - 1 else SPAN if k == 0 else FANOUT
        s = suspects.select(F.col("archive").alias("s_archive"), F.col("pos").alias("s_pos"))

        def under(level: DataFrame, s: DataFrame = s, width: int | None = width) -> DataFrame:
            on = level["archive"].eqNullSafe(s["s_archive"])
            return level.join(s, on if width is None else on & (F.floor(level["pos"] / width) == s["s_pos"]), "left_semi")

        found = _differing(under(a.levels[k]), under(b.levels[k]), ["pos"])
        if k:
            suspects = durable(found.select("archive", "pos"))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("corrupt")
    return found.select("archive", F.when(F.col("pos") >= 0, F.col("pos")).alias("offset"), "length", status.alias("status"))


def compare_replicas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Trees of two replicas (archive, offset, digest, length) and their audit.

    Columns besides these are ignored. An empty replica misses, or has, all records; two
    empty ones, and equal ones, give no rows; repeated rows count by their number.
    """
    leaves = tree_leaves(a), tree_leaves(b)
    depth = max(tree_depth(x) for x in leaves)
    return audit(*(grow(x, depth) for x in leaves))


#: Bytes unpacked at once.
PIECE = 1 << 16
HEAD = re.compile(rb"WARC/\d\.\d\r\n(.*?)\r\n\r\n", re.DOTALL)


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member at an offset, unpacked, and the offset behind it."""
    box, out = zlib.decompressobj(31), []
    while not box.eof and at < len(data):
        piece = data[at : at + PIECE]
        out.append(box.decompress(piece))
        at += len(piece)
    return b"".join(out), at - len(box.unused_data)


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Records of an archive, plain or with a gzip member for each: (offset, stored length, headers by lower-case name, payload).

    Linear in the archive's size. An empty archive has no records; bytes that are no
    record raise an error that names their offset.
    """
    view, at = memoryview(data), 0
    packed = data[:2] == b"\x1f\x8b"
    while at < len(data):
        raw, end = _member(view, at) if packed else (data, at)
        m = HEAD.match(raw, 0 if packed else at)
        if not m:
            raise ValueError(f"no WARC record at offset {at}")
        lines = (line.partition(":") for line in m[1].decode("utf-8", "replace").split("\r\n"))
        heads = {name.strip().lower(): value.strip() for name, colon, value in lines if colon}
        n = int(heads.get("content-length") or 0)
        end = end if packed else m.end() + n + 4
        yield at, end - at, heads, bytes(raw[m.end() : m.end() + n])
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: (archive, offset, length, uri, payload, digest); one task reads a file. Empty files have none; a missing uri is null."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(path, o, n, h.get("warc-target-uri"), p) for o, n, h, p in parse_warc(content)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["archive", "offset", "length", "uri", "payload"])

    return files.mapInArrow(run, "archive string, offset long, length long, uri string, payload binary").withColumn("digest", digest(F.col("payload")))


def pack_warc(records: list[tuple[str, str, bytes]], packed: bool = False) -> bytes:
    """A WARC file of (record id, uri, payload) rows."""
    out = []
    for key, uri, payload in records:
        raw = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{key}>\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"
        out.append(gzip.compress(raw, mtime=0) if packed else raw)
    return b"".join(out)
