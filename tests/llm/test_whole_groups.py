"""Near copies among rows whose ids are null or reused."""


def test_one_of_each_class_whatever_its_ids(spark):
    from twinfold.llm.near_join import near_groups, one_of_each

    say = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, say("a", 60)), (None, say("a", 61)), (None, say("b", 60)), (None, say("b", 61)), (5, say("c", 60)), (6, say("c", 61)), (5, say("d", 60)), (7, say("d", 61))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"][0]) for r in one_of_each(docs, near_groups(docs)).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a"), (None, "b"), (5, "c"), (5, "d")], key=str)
