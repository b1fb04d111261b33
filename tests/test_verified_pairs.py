"""Verified pairs against all pairs."""

import random


def test_all_pairs_at_the_threshold_are_found(spark, tmp_path):
    from twinfold.plans.queries import minhash_verified

    rnd = random.Random(5)
    texts = []
    for g in range(25):
        base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)]
        new = list(base)
        for at in range(0, 400, 52):  # eight changes leave about 0.82 of the grams
            new[at] = "0123456789"[rnd.randrange(10)]
        texts += ["".join(base), "".join(new)]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.82}
    assert len(want) >= 20
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["left"], r["right"]) for r in minhash_verified(spark, str(tmp_path)).collect()}
    assert got == want


def test_classes_stand_for_all_exact_pairs(spark):
    from twinfold.operators import pairs as P

    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 40 + ["b"] * 3 + ["c", "", "", None, None])], "item_id long, h string")
    got = P.exact_classes(rows, "h", "item_id").collect()
    made = {(a["item"], b["item"]) for a in got for b in got if a["k"] == b["k"] and a["item"] < b["item"]}
    assert made == {tuple(r) for r in P.all_pairs(rows, "h", "item_id").collect()} and len(got) == 43
    assert {r["representative"]: r["pairs"] for r in got} == {0: 780, 40: 3}
