"""The document engine end to end: files to documents and chunks, to clusters, members and a report.

Groups of equal hashes are never expanded into pairs. Clusters follow from one link for
each copy; how many pairs of a cluster are equal follows from the sizes of its groups, by
inclusion and exclusion over the three hashes; near pairs are found between distinct
texts and weigh as many pairs as their copies make. Estimated near pairs are summed bucket
by bucket and never listed either.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.text import grams, normalize_text, stable_id
from twinfold.operators import clusters as C
from twinfold.operators import pairs as P
from twinfold.operators.banded import UNIT, band_rows, near_sums
from twinfold.operators.chunking import chunk_markdown
from twinfold.operators.components import components, shared_checkpoint
from twinfold.sources.files import changed, parse_documents

#: Hash of a chunk's keys by the type of match it stands for, strongest first.
KEYS = {"file_exact": "file_key", "text_exact": "doc_key", "chunk_exact": "text_hash"}

# Sentences of the summary.
REASON = "选择 %s 作为主版本候选，综合路径关键词、更新时间、版本号、格式和内容完整度得分 %.2f。"
SUMMARY = " 簇内共有 %d 个片段，平均相似度 %.2f。"


@dataclass
class DocReport:
    """clusters: one row each; members: one row for each chunk of a cluster."""

    clusters: DataFrame
    members: DataFrame


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of scanned files; files that can't be parsed are left out."""
    parsed = parse_documents(files).where(~F.col("failed")).select("doc_id", "title", normalize_text(F.col("markdown")).alias("text"))
    docs = files.drop("content").join(parsed, "doc_id").withColumn("normalized_text_hash", F.sha2("text", 256))
    return docs, chunk_markdown(docs, "doc_id", "text")


def scan_counters(files: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: total, processed, skipped (stored with the same hash) and failed."""
    new = parse_documents(changed(files, stored)).select("doc_id", "failed")
    return files.select("doc_id").join(new, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("failed") == F.lit(False)).alias("processed"), F.count_if(F.col("failed").isNull()).alias("skipped"), F.count_if(F.col("failed") == F.lit(True)).alias("failed")
    )


def keyed_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, text, text_hash, file_key, doc_key); a document's hashes go with its least chunk only."""
    least = P.representative_chunks(chunks).join(documents.select("doc_id", F.nullif("file_hash", F.lit("")).alias("file_key"), F.nullif("normalized_text_hash", F.lit("")).alias("doc_key")), "doc_id")
    return chunks.select("chunk_id", "doc_id", "section_path", "text", F.nullif("text_hash", F.lit("")).alias("text_hash")).join(least.drop("doc_id"), "chunk_id", "left")


def near_links(keyed: DataFrame, near: str = "estimate", threshold: float = 0.82) -> DataFrame:
    """(ta, tb, a, b, score, pairs): distinct texts that nearly agree, their least chunks, and how many pairs of chunks that is; a row for each pair, ``near_weights`` has the sums.

    estimate: candidates of the bands, scored by equal slots, whole agreement left out;
    verified: candidates of more and shorter bands with an exact gram Jaccard of threshold or more.
    """
    texts = shared_checkpoint(keyed.groupBy("text_hash").agg(F.min("chunk_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("text").alias("text")).where(F.col("text_hash").isNotNull()))
    signed = shared_checkpoint(texts.select("id", "text_hash", "n", P.minhash(normalize_text(F.col("text"))).alias("sig")))
    cand = P.lsh_candidates(signed, "id", *(P.SURE_BANDS if near == "verified" else ()))
    a = signed.select(F.col("id").alias("left"), F.col("text_hash").alias("ta"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = signed.select(F.col("id").alias("right"), F.col("text_hash").alias("tb"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    if near == "verified":
        scored = P.score_pairs(cand, texts.select("id", grams(normalize_text(F.col("text"))).alias("g"))).where(F.col("similarity") >= threshold)
        both = scored.select("left", "right", "similarity").join(a.drop("sa"), "left").join(b.drop("sb"), "right")
    else:
        both = cand.join(a, "left").join(b, "right").withColumn("similarity", P.estimate(F.col("sa"), F.col("sb"))).where("similarity < 1")
    links = both.select("ta", "tb", F.col("left").alias("a"), F.col("right").alias("b"), F.bround("similarity", 4).alias("score"), (F.col("na") * F.col("nb")).alias("n"))
    # Pairs that a document's hash joins anyway are no near pairs.
    out = links.withColumn("pairs", F.col("n"))
    for sign, keys in ((-1, ["file_key"]), (-1, ["doc_key"]), (1, ["file_key", "doc_key"])):
        counted = keyed.where(" and ".join(f"{k} is not null" for k in keys)).groupBy("text_hash", *keys).agg(F.count(F.lit(1)).alias("c"))
        x, y = counted.withColumnsRenamed({"text_hash": "ta", "c": "ca"}), counted.withColumnsRenamed({"text_hash": "tb", "c": "cb"})
        shared = links.select("ta", "tb").join(x, "ta").join(y, ["tb", *keys]).groupBy("ta", "tb").agg(F.sum(F.col("ca") * F.col("cb")).alias("s"))
        out = out.join(shared, ["ta", "tb"], "left").withColumn("pairs", F.col("pairs") + sign * F.coalesce("s", F.lit(0))).drop("s")
    return out.where("pairs > 0").drop("n")


def near_weights(keyed: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left, right) edges and (chunk_id, pairs, total) sums of the estimated near pairs of ``near_links``, whose pairs are not listed. chunks holds the texts."""
    texts = chunks.where(F.col("text_hash") != "").groupBy("text_hash").agg(F.min("chunk_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    signed = shared_checkpoint(texts.select("id", "text_hash", "n", F.transform(P.minhash(normalize_text(F.col("text"))), lambda v: v.bitwiseAND(0x7FFFFFFF).cast("int")).alias("sig")))
    sums = near_sums(signed.select("id", "n", "sig"))
    weights = sums.where(F.col("b").isNull()).select(F.col("a").alias("chunk_id"), "pairs", (F.col("total") / UNIT).alias("total"))
    # Pairs that a document's hash joins anyway are no near pairs. Documents of one hash have the same texts, so these are as many as one document's texts make.
    for sign, keys in ((-1, ["file_key"]), (-1, ["doc_key"]), (1, ["file_key", "doc_key"])):
        counted = keyed.where(" and ".join(f"{k} is not null" for k in ["text_hash", *keys])).groupBy("text_hash", *keys).agg(F.count(F.lit(1)).alias("c"))
        several = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
        some = counted.join(several, keys).join(signed.select("text_hash", "id", "sig"), "text_hash").select(*keys, "id", "c", "sig")
        met = some.select(*keys, "id", "c").join(band_rows(some.select("id", "sig").dropDuplicates(["id"])), "id")
        x, y = met.withColumnsRenamed({"id": "left", "c": "ca"}), met.withColumnsRenamed({"id": "right", "c": "cb"})
        both = x.join(y, [*keys, "k", "band"]).where("left < right").select(*keys, "left", "right", (F.col("ca") * F.col("cb")).alias("n")).distinct().groupBy("left", "right").agg((sign * F.sum("n")).alias("pairs"))
        both = both.join(signed.select(F.col("id").alias("left"), F.col("sig").alias("sa")), "left").join(signed.select(F.col("id").alias("right"), F.col("sig").alias("sb")), "right").withColumn("score", P.estimate(F.col("sa"), F.col("sb"))).where("score < 1")
        weights = weights.unionByName(both.select(F.col("left").alias("chunk_id"), "pairs", (F.col("pairs") * F.bround("score", 4)).alias("total")))
    # Edges of such pairs join what their hashes join.
    return sums.where(F.col("b").isNotNull()).select(F.col("a").alias("left"), F.col("b").alias("right")), weights


def equal_pairs(keyed: DataFrame) -> DataFrame:
    """(chunk_id, pairs): the number of pairs that share a hash, each counted once, booked on the least chunk of its group."""
    out = None
    for size in (1, 2, 3):
        for keys in combinations(KEYS.values(), size):
            n = F.count(F.lit(1))
            some = keyed.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min("chunk_id").alias("chunk_id"), ((1 if size % 2 else -1) * F.floor(n * (n - 1) / 2)).alias("pairs")).select("chunk_id", "pairs")
            out = some if out is None else out.unionByName(some)
    return out.where("pairs != 0").groupBy("chunk_id").agg(F.sum("pairs").alias("pairs"))  # type: ignore[union-attr]


def analyse_documents(documents: DataFrame, chunks: DataFrame, near: str | None = "estimate", threshold: float = 0.82) -> DocReport:
    """Clusters of chunks. documents: (doc_id, path, filename, file_ext, mtime, file_hash, normalized_text_hash); chunks as ``chunk_markdown`` gives them.

    All stored documents are compared. A cluster is named after its least chunk, as a
    list of all its members has no bound. similarity_score of members is 1, as the
    engine has always had it; confidence is the mean over all pairs. Null hashes match
    nothing; without chunks there are no clusters.
    """
    # Texts are dealt anew only to be signed; all else goes without them.
    chunks = shared_checkpoint(chunks.select("chunk_id", "doc_id", "section_path", "text", "text_hash"))
    text = F.col("text")
    slim = chunks.select("chunk_id", "section_path", F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, 160).alias("preview"), F.length(text).alias("length"))
    keyed = shared_checkpoint(keyed_chunks(documents, chunks.withColumn("text", F.lit(None).cast("string"))).drop("text", "section_path"))
    edges = None
    for key in KEYS.values():
        star = P.star_links(keyed.where(F.col(key).isNotNull()), key, "chunk_id")
        edges = star if edges is None else edges.unionByName(star)
    near_edges = weights = None
    if near == "verified":
        close = shared_checkpoint(near_links(keyed.join(chunks.select("chunk_id", "text"), "chunk_id"), near, threshold))
        near_edges, weights = close.select(F.col("a").alias("left"), F.col("b").alias("right")), close.select(F.col("a").alias("chunk_id"), "pairs", (F.col("pairs") * F.col("score")).alias("total"))
    elif near:
        near_edges, weights = near_weights(keyed, chunks)
    if near_edges is not None:
        edges = edges.unionByName(near_edges)  # type: ignore[union-attr]
    comp = shared_checkpoint(components(edges).select(F.col("node").alias("chunk_id"), F.col("component").alias("first")))  # type: ignore[arg-type]

    score = F.lit(1.0)
    weighed = equal_pairs(keyed).withColumn("total", F.col("pairs") * score)
    if weights is not None:
        weighed = weighed.unionByName(weights)
    means = weighed.join(comp, "chunk_id").groupBy("first").agg(F.sum("pairs").alias("n_pairs"), F.round(F.sum("total") / F.sum("pairs"), 4).alias("confidence"))

    matched = comp.join(keyed, "chunk_id")
    for kind, key in KEYS.items():
        several = P.groups(keyed.select("chunk_id", key), key, "chunk_id").select(key, F.lit(kind).alias(kind))
        matched = matched.join(several, key, "left")
    rank = F.create_map(*[F.lit(x) for kv in P.DOC_RANK.items() for x in kv])
    matched = matched.join(slim, "chunk_id")
    docs = documents.select("doc_id", "path", "filename", "file_ext", F.unix_timestamp("mtime").alias("epoch"))
    members = matched.withColumn("match_type", F.coalesce(*KEYS, F.lit("chunk_near"))).join(docs, "doc_id", "left").withColumn("cluster_id", stable_id("clu", F.col("first")))
    members = shared_checkpoint(
        members.select("cluster_id", "first", "chunk_id", "doc_id", "filename", "section_path", "match_type", F.lit(1.0).alias("similarity_score"), "preview", C.length_score(F.col("path"), F.col("filename"), F.col("file_ext"), F.col("epoch"), F.col("length")).alias("score"))
    )
    best = C.canonical(members, "cluster_id", "chunk_id", "score").join(members.select(F.col("cluster_id"), F.col("chunk_id").alias("canonical_chunk_id"), "filename"), ["cluster_id", "canonical_chunk_id"], "left")
    kinds = members.groupBy("cluster_id", "first").agg(F.max_by("match_type", rank[F.col("match_type")]).alias("duplicate_type"))
    rows = kinds.join(means, "first").join(best, "cluster_id")
    action, risk = C.suggest_action(F.col("duplicate_type"), F.col("members"), F.col("confidence"))
    reason = F.format_string(REASON, "filename", "score")
    clusters = rows.select("cluster_id", "duplicate_type", "members", "n_pairs", "confidence", "canonical_chunk_id", risk.alias("risk_level"), action.alias("suggested_action"), F.concat(reason, F.format_string(SUMMARY, "members", "confidence")).alias("summary"))
    return DocReport(clusters, members.drop("first"))


def report_lines(report: DocReport) -> DataFrame:
    """(cluster_id, part, key, line): the Markdown report as rows, in order of the first three columns, so that a report of any size can be written."""

    def block(*rows: Column) -> Column:
        return F.concat_ws("\n", *rows)

    c = F.col
    item = lambda label, value: F.concat(F.lit(f"- {label}: "), value)
    heads = report.clusters.select(
        "cluster_id", F.lit(1).alias("part"), F.lit("").alias("key"),
        block(
            F.concat(F.lit("## Cluster "), c("cluster_id")), F.lit(""), item("Type", c("duplicate_type")), item("Confidence", F.format_string("%.2f", "confidence")), item("Risk", c("risk_level")), item("Suggested action", c("suggested_action")),
            item("Canonical chunk", F.coalesce("canonical_chunk_id", F.lit("N/A"))), item("Summary", F.coalesce("summary", F.lit(""))), F.lit(""), F.lit("### Members"),
        ).alias("line"),
    )
    rows = report.members.where(c("filename").isNotNull()).select("cluster_id", F.lit(2).alias("part"), c("chunk_id").alias("key"), F.format_string("- `%s` `%s` %.2f %s [%s] - %s", "chunk_id", "match_type", "similarity_score", "filename", F.coalesce("section_path", F.lit("root")), "preview").alias("line"))
    total = report.clusters.agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("cluster_id"), F.lit(0).alias("part"), F.lit("").alias("key"), F.format_string("# Document Deduplication Report\n\nTotal clusters: %d\n", "n").alias("line"))
    return total.unionByName(heads).unionByName(rows)
