"""URL filter lists joined as of the fetch time. DataFrame operations only.

A list is a log of dated entries: at a time, a key (a host, a parent domain, or a host
with its first path segment) is added to or removed from a named list. Entries become
validity intervals; every capture is matched with the intervals that were valid when
it was fetched.

Times are epoch seconds. Intervals are cut into periods of ``period`` seconds, and the
join is on (key, period, salt) with the exact interval as a condition: a key that holds
a third of all captures or entries is spread over periods and salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 30 * 86_400
SALTS = 8
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-cased host; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def url_keys(url: Column) -> Column:
    """Keys that list entries can name: each domain suffix of two labels or more, a one-label host, and host/first segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    segment = F.coalesce(F.regexp_extract(url, SEGMENT, 1), F.lit(""))
    path = F.when(segment != "", F.array(F.concat(F.lit("p:"), host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(suffixes, path))


def validity_intervals(entries: DataFrame, period: int = PERIOD) -> DataFrame:
    """(list_name, key, valid_from, valid_to) from a log (list_name, key, action, effective_at).

    action is add or remove; of entries of one list, key and time, a removal wins; an
    entry holds until the next one of its list and key, the last one for ever (valid_to
    null). Entries with a null field are ignored; repeated rows count once. The next
    entry is looked up inside a period first and then among the periods' first entries,
    so one key's log is many window partitions.
    """
    log = entries.select("list_name", "key", "action", F.col("effective_at").cast("long").alias("t")).na.drop()
    log = log.groupBy("list_name", "key", "t").agg(F.max("action").alias("action")).withColumn("span", F.floor(F.col("t") / period))
    own = ["list_name", "key"]
    firsts = log.groupBy(*own, "span").agg(F.min("t").alias("first"))
    firsts = firsts.withColumn("after", F.lead("first").over(Window.partitionBy(*own).orderBy("span"))).drop("first")
    inside = log.withColumn("next", F.lead("t").over(Window.partitionBy(*own, "span").orderBy("t")))
    return inside.join(firsts, [*own, "span"]).where(F.col("action") == "add").select(*own, F.col("t").alias("valid_from"), F.coalesce("next", "after").alias("valid_to"))


def filter_as_of(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", period: int = PERIOD, salts: int = SALTS) -> DataFrame:
    """Every capture with its verdict: (id, url, time, blocked, n_lists, lists, since).

    lists: names of the matching lists, sorted and joined by commas; since: the earliest
    start of a matching interval. An interval holds at its start and no longer at its
    end. Captures with null or hostless urls or null times match nothing and are kept;
    repeated rows are kept as often as they occur; other columns are ignored. Empty
    captures give an empty result, empty lists block nothing.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("long").alias("at"))
    edge = rows.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    low, high = (int(edge["a"] or 0), int(edge["b"] or 0)) if edge else (0, 0)
    valid = validity_intervals(entries, period).where((F.col("valid_from") <= high) & (F.col("valid_to").isNull() | (F.col("valid_to") > low)))
    last = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(high)), F.lit(high))
    spans = F.sequence(F.floor(F.greatest(F.col("valid_from"), F.lit(low)) / period), F.floor(last / period))
    cut = valid.select("list_name", "key", "valid_from", "valid_to", F.explode(spans).alias("span")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = rows.where(F.col("at").isNotNull()).select("id", "url", "at", F.explode(url_keys(F.col("url"))).alias("key"), F.floor(F.col("at") / period).alias("span"), F.pmod(F.xxhash64("id", "url", "at"), F.lit(salts)).cast("int").alias("salt"))
    hits = asked.join(cut, ["key", "span", "salt"]).where((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    # Captures and hits meet in one aggregation: n restores repeated rows, hits add only list names.
    plain = rows.select("id", "url", "at", F.lit(1).alias("n"), F.lit(None).cast("string").alias("list_name"), F.lit(None).cast("long").alias("valid_from"))
    every = plain.unionByName(hits.select("id", "url", "at", F.lit(0).alias("n"), "list_name", "valid_from"))
    named = every.groupBy("id", "url", "at").agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("list_name")).alias("names"), F.min("valid_from").alias("since"))
    out = named.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(time_col), (F.size("names") > 0).alias("blocked"), F.size("names").cast("long").alias("n_lists"), F.array_join("names", ",").alias("lists"), "since")
