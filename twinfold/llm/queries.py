"""Queries of this subpackage over the tables of a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folded_crc, read_table
from .decontaminate import leaks
from .extract import extract_main_text
from .graph_search import nearest_neighbours
from .mixing import mix_sources
from .near_join import near_groups
from .quality import grade_documents, train_quality
from .token_counts import token_counts
from .toxicity import score_toxicity, train_toxicity
from .url_filter import filter_as_of, host_of
from .warc import compare_replicas, lay_out, record_bytes

__all__ = ["ORACLES", "QUERIES"]

#: Pages of one archive file.
ARCHIVE_PAGES = 1000


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in two replicas. In the second, chosen by the hash of the page id, some records rot and some are lost; the audit locates them."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    raw = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    mark = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    rotten = F.concat(F.substring(F.col("raw"), F.lit(1), F.char_length("raw") - 1), F.lit("#"))
    records = pages.withColumn("raw", raw).select(
        F.floor(F.col("page_id") / ARCHIVE_PAGES).cast("string").alias("archive"), F.col("page_id").alias("id"), "url", F.octet_length("raw").cast("long").alias("length"),
        F.sha2("raw", 256).alias("digest"), mark.alias("mark"), F.when(mark == "00", F.sha2(rotten, 256)).alias("rotten"),
    )
    laid = lay_out(records, order=["id", "url", "digest"])
    second = laid.where(F.col("mark") != "01").withColumn("digest", F.coalesce("rotten", "digest"))
    return compare_replicas(laid, second)


OP1_SQL = """
WITH r AS (
  SELECT page_id, url, md5(CAST(page_id AS VARCHAR)) AS m, CAST(floor(page_id / 1000) AS BIGINT) AS a,
    strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS n
  FROM pages),
laid AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY a ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM r)
SELECT CAST(a AS VARCHAR) AS archive, CAST(o AS BIGINT) AS "offset", CAST(n AS BIGINT) AS length, CASE substr(m, 1, 2) WHEN '00' THEN 'corrupt' ELSE 'missing' END AS status
FROM laid WHERE substr(m, 1, 2) IN ('00', '01')
"""


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and top-grade probability of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, read_table(spark, sf_dir, "labels"))
    return grade_documents(docs, model).select("doc_id", (folded_crc("doc_id") == 0).alias("held_out"), "expected_grade", "tail_prob", "selected")


def op3_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", (folded_crc("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector."""
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), lambda key: key % 100 == 0)


def op5_pigeonhole_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _hex(text, start: int):  # noqa: ANN001, ANN202
    """Four hexadecimal digits of an md5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), start, 4), 16, 10).cast("long")


#: Start of the year of the captures, in epoch seconds.
T0 = 1_704_067_200


def op6_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures of one year, against lists of dated entries on their hosts, domains and paths.

    The tables hold no fetch times and no lists: both follow from hashes of the page id and of the host.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.lit(T0) + _hex(F.col("page_id").cast("string"), 1) * 480)
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^[A-Za-z]+://[^/]+/([^/?#]+)", 1).alias("seg")).where("host != ''").distinct()
    day = 86_400

    def log(rows: DataFrame, name: str, key, subject, first: int, keep) -> DataFrame:  # noqa: ANN001
        start = F.lit(T0 - 30 * day) + _hex(subject, first) * 240
        rows = rows.where(keep).select(key.alias("key"), start.alias("t"), _hex(subject, 9).alias("k")).distinct()
        events = F.array(
            F.struct(F.lit("add").alias("action"), F.col("t").alias("effective_at")),
            F.struct(F.lit("remove").alias("action"), (F.col("t") + (F.col("k") % 120 + 1) * day).alias("effective_at")),
            F.struct(F.lit("add").alias("action"), (F.col("t") + (F.col("k") % 300 + 90) * day).alias("effective_at")),
        )
        return rows.select(F.lit(name).alias("list_name"), "key", F.explode(events).alias("e")).select("list_name", "key", "e.action", "e.effective_at")

    host, domain, path = F.col("host"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.concat(F.col("host"), F.lit("/"), F.col("seg"))
    entries = (
        log(hosts, "malware", F.concat(F.lit("d:"), host), host, 1, _hex(host, 5) % 4 == 0)
        .unionByName(log(hosts, "spam", F.concat(F.lit("d:"), domain), domain, 5, (domain != "") & (_hex(domain, 1) % 3 == 0)))
        .unionByName(log(hosts, "adult", F.concat(F.lit("p:"), path), path, 13, (F.col("seg") != "") & (_hex(path, 5) % 5 == 0)))
    )
    return filter_as_of(captures, entries).withColumn("since", F.coalesce("since", F.lit(-1).cast("long")))


OP6_SQL = r"""
WITH RECURSIVE c AS (
  SELECT page_id, url, 1704067200 + CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4) AS BIGINT) * 480 AS ts,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z]+://[^/]+/([^/?#]+)', 1) AS seg FROM pages),
h AS (SELECT DISTINCT host, seg FROM c WHERE host <> ''),
s AS (
  SELECT DISTINCT 'malware' AS list_name, 'd:' || host AS key, host AS w, 1 AS f FROM h WHERE CAST('0x' || substr(md5(host), 5, 4) AS BIGINT) % 4 = 0
  UNION ALL SELECT DISTINCT 'spam', 'd:' || regexp_extract(host, '([^.]+\.[^.]+)$', 1), regexp_extract(host, '([^.]+\.[^.]+)$', 1), 5 FROM h
    WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> '' AND CAST('0x' || substr(md5(regexp_extract(host, '([^.]+\.[^.]+)$', 1)), 1, 4) AS BIGINT) % 3 = 0
  UNION ALL SELECT DISTINCT 'adult', 'p:' || host || '/' || seg, host || '/' || seg, 13 FROM h WHERE seg <> '' AND CAST('0x' || substr(md5(host || '/' || seg), 5, 4) AS BIGINT) % 5 = 0),
t AS (SELECT list_name, key, 1704067200 - 2592000 + CAST('0x' || substr(md5(w), f, 4) AS BIGINT) * 240 AS t, CAST('0x' || substr(md5(w), 9, 4) AS BIGINT) AS k FROM s),
e AS (
  SELECT list_name, key, t, 'add' AS action FROM t
  UNION ALL SELECT list_name, key, t + (k % 120 + 1) * 86400, 'remove' FROM t
  UNION ALL SELECT list_name, key, t + (k % 300 + 90) * 86400, 'add' FROM t),
x AS (SELECT list_name, key, t, max(action) AS action FROM e GROUP BY ALL),
v AS (SELECT *, lead(t) OVER (PARTITION BY list_name, key ORDER BY t) AS until FROM x),
tails AS (
  SELECT DISTINCT host, host AS tail FROM h
  UNION ALL SELECT host, substr(tail, strpos(tail, '.') + 1) FROM tails WHERE length(tail) - length(replace(tail, '.', '')) >= 2),
k AS (
  SELECT DISTINCT c.page_id, c.url, c.ts, 'd:' || tails.tail AS key FROM c JOIN tails USING (host)
  UNION SELECT page_id, url, ts, 'p:' || host || '/' || seg FROM c WHERE host <> '' AND seg <> ''),
m AS (
  SELECT k.page_id, k.url, k.ts, list_name, min(v.t) AS since FROM k JOIN v USING (key)
  WHERE v.action = 'add' AND v.t <= k.ts AND (v.until IS NULL OR k.ts < v.until) GROUP BY ALL),
g AS (SELECT page_id, url, ts, count(*) AS n, string_agg(list_name, ',' ORDER BY list_name) AS lists, min(since) AS since FROM m GROUP BY ALL)
SELECT c.page_id, c.url, c.ts AS fetched_at, g.n IS NOT NULL AS blocked, CAST(coalesce(g.n, 0) AS BIGINT) AS n_lists, coalesce(g.lists, '') AS lists, CAST(coalesce(g.since, -1) AS BIGINT) AS since
FROM c LEFT JOIN g ON c.page_id = g.page_id AND c.url = g.url AND c.ts = g.ts
"""


def op7_bayesian_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of all documents."""
    return near_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_max_subsequence_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op9_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards", "order_keys")


def op10_rank_synchronous_tokens(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token counts of all documents."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle_fixity": op1_merkle_fixity,
    "op2_ordinal_quality": op2_ordinal_quality,
    "op3_kneser_ney_toxicity": op3_kneser_ney_toxicity,
    "op4_robust_pruned_graph": op4_robust_pruned_graph,
    "op5_pigeonhole_edit_matching": op5_pigeonhole_edit_matching,
    "op6_temporal_url_filter": op6_temporal_url_filter,
    "op7_bayesian_jaccard_join": op7_bayesian_jaccard_join,
    "op8_max_subsequence_html": op8_max_subsequence_html,
    "op9_hypergeometric_mix": op9_hypergeometric_mix,
    "op10_rank_synchronous_tokens": op10_rank_synchronous_tokens,
}
ORACLES: dict[str, str] = {"op1_merkle_fixity": OP1_SQL, "op6_temporal_url_filter": OP6_SQL}
