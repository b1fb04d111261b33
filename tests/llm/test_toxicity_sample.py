"""The toxicity sample's bound on bytes."""


def test_a_text_that_does_not_fit_leaves_the_others_in(spark):
    from pyspark.sql import functions as F

    from twinfold.llm.common import folded_crc
    from twinfold.llm.toxicity import train_toxicity

    rows = [(i, f"{'foul' if i % 2 else 'fair'} é{i % 7} word{i % 5} word{i % 3} foot") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    first = docs.where(folded_crc("doc_id") != 0).orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    large = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("large "), 10_000)).otherwise(F.col("text")))
    model = train_toxicity(large, labels, most_bytes=50_000)
    assert {"foul", "fair"} <= set(model.vocabulary) and "large" not in model.vocabulary
    assert model.score("foul foul") > 0.5 > model.score("fair fair")
    # Bytes count, not characters.
    wide = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("é "), 20_000)).otherwise(F.col("text")))
    assert "é" not in train_toxicity(wide, labels, most_bytes=50_000).vocabulary
