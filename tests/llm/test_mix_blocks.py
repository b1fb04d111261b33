"""The mix: targets by another way of reckoning, repeated rows, the local shuffle."""

import random


def water_level(sizes, plan):
    """Targets as min(cap, level * weight), the level found by bisection."""
    weights = [plan.weights[i % len(plan.weights)] for i in range(len(sizes))]
    whole = plan.share * sum(sizes)
    at = lambda level: [min(plan.cap * s, level * w) for s, w in zip(sizes, weights, strict=True)]
    lo, hi = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) < whole else (lo, mid)
    return at(hi)


def test_targets_equal_the_water_level():
    from twinfold.llm.mixing import MixPlan, fill_targets

    rnd = random.Random(1)
    for _ in range(200):
        sizes = [rnd.choice([0, 1, 5, 100, 10_000, 10**9]) * rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 9))]
        got, want = fill_targets(sizes, MixPlan()), water_level(sizes, MixPlan())
        assert all(abs(a - b) <= 1e-6 * (1 + b) for a, b in zip(got, want, strict=True))
    assert fill_targets([], MixPlan()) == []


def test_repeated_rows_are_spread_over_blocks(spark):
    from pyspark.sql import functions as F

    from twinfold.llm.mixing import MixPlan, mix_sources, numbered_repeats

    rows = [(1, "same text here", "a")] * 1000 + [(i, f"text {i} of it", "a") for i in range(2, 400)] + [(7, None, None)] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = frame.select(F.length("text").alias("size"), F.xxhash64("doc_id", "text", "source").alias("h"), F.spark_partition_id().alias("part"))
    numbered = numbered_repeats(keyed)
    assert numbered.count() == len(rows) == numbered.select("h").distinct().count()
    got = [tuple(r) for r in mix_sources(frame, MixPlan(least_blocks=32)).select("doc_id", "size", "taken").collect()]
    assert len(got) == len(rows)
    taken = [t for i, _, t in got if i == 1]
    assert set(taken) <= {0, 3, 6} and len(set(taken)) > 1  # copies of one row fare differently
    again = [tuple(r) for r in mix_sources(frame.repartition(3), MixPlan(least_blocks=32)).select("doc_id", "size", "taken").collect()]
    assert sorted(got, key=str) == sorted(again, key=str)


def test_rows_of_a_shard_are_shuffled(spark):
    from twinfold.llm.mixing import MixPlan, mix_sources, shard_rows

    frame = spark.range(2000).selectExpr("id as doc_id", "'one two' as text", "'s' as source")
    mix = mix_sources(frame, MixPlan(shards=2))
    draws = shard_rows(mix).collect()
    assert len(draws) == sum(len(r["shards"]) for r in mix.collect()) == 3000
    for shard in (0, 1):
        mine = sorted((r["order_key"], r["doc_id"]) for r in draws if r["shard"] == shard)
        ids = [i for _, i in mine]
        assert len({k for k, _ in mine}) == len(mine) and sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.6 * len(ids)


def test_many_sources_split_fast():
    from twinfold.llm.mixing import split_quotas

    q = split_quotas([3] * 20_000, 4, 1)
    assert q.sum(0).tolist() == [3] * 20_000 and q.sum(1).tolist() == [15_000] * 4
