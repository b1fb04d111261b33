"""Counters of candidate pairs and near pairs of buckets against listed pairs."""

import random


def chunks(spark, size=400):
    rnd = random.Random(3)
    words = [f"{rnd.choice('aäbñ字')}{rnd.randrange(300)}" for _ in range(60)]
    rows = []
    for i in range(size):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60)))
        rows.append((i if i % 9 else i // 2, None if i % 31 == 0 else i % 12, rnd.choice(["u", "v", None]) if i % 5 == 0 else "u", text, max(1, len(text) // 3)))
    rows += [(9001, 40, "u", "ab", 1), (9002, 41, "u", "AB", 1), (9003, 42, "u", "", 1), (9004, 43, "u", "", 1)]
    return spark.createDataFrame(rows, "id long, p long, role string, text string, n long")


def test_counters_are_those_of_listed_pairs_without_listing_them(spark):
    from pyspark.sql import functions as F

    from twinfold.operators import pairs as P

    rows = chunks(spark)
    far = F.col("ratio") < 0.55
    want = P.bucket_candidates(rows, "id", "p", ["role"], "n").agg(F.count(F.lit(1)), F.count_if(~F.col("same_path") & ~far), F.count_if("same_path"), F.count_if(~F.col("same_path") & far)).first()
    got = P.pair_counters(rows, "id", "p", ["role"], "n")
    assert tuple(got.first()) == tuple(want) and min(want) > 0
    assert tuple(P.pair_counters(rows.limit(0), "id", "p", ["role"], "n").first()) == (0, 0, 0, 0)
    # As many copies as make 2 * 10 ** 11 pairs.
    many = spark.range(2_000_000).select("id", F.col("id").alias("p"), F.lit("u").alias("role"), (F.col("id") % 20 + 1).alias("n"))
    assert P.pair_counters(many, "id", "p", ["role"], "n").first()["candidate_pairs"] == 2_000_000 * 1_999_999 // 2


def test_near_pairs_of_blocks_are_those_of_listed_candidates(spark, monkeypatch):
    from pyspark.sql import functions as F

    from twinfold.functions.text import grams
    from twinfold.operators import pairs as P

    rows = chunks(spark).where("id > 200 or id % 9 > 0")
    rows = rows.dropDuplicates(["id"])
    rows = rows.localCheckpoint()
    cand = P.bucket_candidates(rows, "id", "p", ["role"], "n").where("not same_path and ratio >= 0.55").select("left", "right")
    want = {tuple(r) for r in P.score_pairs(cand, rows.select("id", grams(F.col("text")).alias("g"))).where("similarity >= 0.1").collect()}
    assert len(want) > 1000
    for block, listed in ((2048, 2048), (30, 4)):
        monkeypatch.setattr(P, "BLOCK", block)
        monkeypatch.setattr(P, "LISTED", listed)
        found = P.near_pairs(rows, "id", "p", ["role"], "n", "text", 0.1)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        # No candidate is a row of a join: rows meet pairs of blocks by broadcast.
        assert "SortMergeJoin" not in found._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_shared_grams_are_counted_by_lists_and_by_products():
    import numpy as np

    from twinfold.operators import pairs as P

    rng = np.random.default_rng(4)
    xs, ys = ([np.unique((rng.random(rng.integers(0, 200)) ** 3 * 900).astype(np.uint64)) for _ in range(n)] for n in (130, 90))
    assert (P.shared_grams(xs, ys) == [[np.intersect1d(x, y).size for y in ys] for x in xs]).all()
    assert P.shared_grams(xs[:1], []).shape == (1, 0)


def test_pairs_are_scored_from_texts_as_from_grams(spark):
    from pyspark.sql import functions as F

    from twinfold.operators import pairs as P

    texts = spark.createDataFrame([(1, "Abcdefgh"), (2, "abcdefghi"), (3, ""), (4, None), (5, "ab"), (6, "字字字字字字")], "id long, t string")
    pairs = spark.createDataFrame([(a, b) for a in range(1, 7) for b in range(a + 1, 7)], "left long, right long")
    low = texts.select("id", F.lower("t").alias("t"))
    want = {tuple(r) for r in P.score_pairs(pairs, texts.select("id", P.gram_sets(F.col("t")).alias("g"))).collect()}
    got = P.score_texts(pairs, low)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 15
    assert "array" not in got._jdf.queryExecution().optimizedPlan().toString()
