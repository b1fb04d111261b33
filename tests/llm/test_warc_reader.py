"""Reading WARC archives: linear time, headers as the format allows them, large audits."""

import time

import pytest


def archive(n, size, packed):
    from twinfold.llm.warc import pack_warc

    return pack_warc([(f"r{i}", f"http://h/{i}", b"x" * size) for i in range(n)], packed)


@pytest.mark.parametrize("packed", [False, True])
def test_time_is_linear(packed):
    from twinfold.llm.warc import parse_warc

    took = []
    for n in (2_000, 16_000):
        data = archive(n, 4_000, packed)
        began = time.perf_counter()
        rows = [(at, size) for at, size, _, _ in parse_warc(data)]
        took.append(time.perf_counter() - began)
        assert len(rows) == n and sum(s for _, s in rows) == len(data) and rows[1][0] == rows[0][1]
    assert took[1] < 24 * took[0] + 0.5


def test_headers_and_faults():
    from twinfold.llm.warc import parse_warc

    data = b"WARC/1.0\r\nContent-Length:3\r\nwarc-target-URI:  http://a:80/ \r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [(h.get("warc-target-uri"), p) for _, _, h, p in parse_warc(data)] == [("http://a:80/", b"abc"), (None, b"")]
    assert list(parse_warc(b"")) == []
    with pytest.raises(ValueError, match="offset 0"):
        list(parse_warc(b"junk"))


def test_audit_of_many_records_with_extra_columns_and_ties(spark):
    from pyspark.sql import functions as F

    from twinfold.llm.warc import compare_replicas, digest, lay_out

    rows = spark.range(8_000).selectExpr("cast(id % 3 as string) as archive", "id", "repeat('p', cast(id % 9000 as int)) as payload", "'x' as hash", "1 as pos", "2 as status")
    base = lay_out(rows.withColumn("length", F.octet_length("payload").cast("long") + 100).withColumn("digest", digest(F.col("payload"))))
    bad = base.withColumn("digest", F.when(F.col("id").isin(17, 7_999), F.lit("bad")).otherwise(F.col("digest"))).where("id != 4000")
    want = {(r["archive"], r["offset"], "missing" if r["id"] == 4000 else "corrupt") for r in base.where("id in (17, 4000, 7999)").collect()}
    assert {(r["archive"], r["offset"], r["status"]) for r in compare_replicas(base, bad).collect()} == want
    twice = base.unionByName(base.where("id = 5"))
    assert [r["status"] for r in compare_replicas(base, twice).collect()] == ["corrupt"]
    nulls = base.withColumn("archive", F.when(F.col("id") % 2 == 0, F.col("archive"))).withColumn("digest", F.when(F.col("id") != 3, F.col("digest")))
    assert compare_replicas(nulls, nulls).count() == 0
    assert compare_replicas(base.limit(0), base.where("id < 9")).count() == 9
