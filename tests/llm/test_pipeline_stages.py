"""The pipeline's stages against plain versions, and on odd rows and empty tables."""

import pytest
from test_mix_blocks import water_level
from test_ops import ODD, T, brute_groups


def rows_of(frame, columns=("doc_id", "text", "lang", "source", "n_chars")):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_stages_against_plain_versions(spark, sf_dir):
    import corpus_pipeline as P
    from twinfold.llm.decontaminate import ERROR_RATE, LEAST_CHARS, masks, myers, normal
    from twinfold.llm.mixing import MixPlan
    from twinfold.llm.quality import train_quality
    from twinfold.llm.toxicity import train_toxicity

    stages = dict(P.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    now = rows_of(docs)

    graded = stages["quality"](spark, docs, sf_dir)
    model = train_quality(docs, labels)
    now = [r for r in now if model.grade(r[1])[1] >= 0.5]
    assert rows_of(graded) == now and 0 < len(now) < docs.count()

    clean = stages["toxicity"](spark, graded, sf_dir)
    model = train_toxicity(graded, labels)
    now = [r for r in now if model.score(r[1]) < 0.5]
    assert rows_of(clean) == now

    single = stages["near_copies"](spark, clean, sf_dir)
    groups = brute_groups([(r[0], r[1]) for r in now])
    first = {i for i, c, _ in groups if i == c}
    now = [r for r in now if r[0] in first]
    assert rows_of(single) == now

    free = stages["benchmark_leaks"](spark, single, sf_dir)
    items = {normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()} - {""}

    def holds(text):
        """Every item against the whole page; the distance is tested against dynamic programming elsewhere."""
        page = normal(text)
        return any(f" {i} " in f" {page} " if len(i) < LEAST_CHARS else i in page or myers(masks(i), len(i), page)[0] <= int(len(i) * ERROR_RATE) for i in items)

    short = [r for r in now if len(r[1]) < 6000][:60]
    kept = {r[0] for r in rows_of(free)}
    assert {r[0] for r in short if not holds(r[1])} == {r[0] for r in short if r[0] in kept}

    mixed = stages["mix"](spark, free, sf_dir).collect()
    assert sorted(r["doc_id"] for r in mixed) == sorted(kept)
    sizes = {}
    for r in mixed:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted(sizes)
    for name, target in zip(names, water_level([sizes[n] for n in names], MixPlan()), strict=True):
        mine = [r for r in mixed if r["source"] == name]
        assert abs(sum(r["taken"] for r in mine) - target) <= max(r["size"] for r in mine) / 2 + 1e-6 and all(r["taken"] <= 2 * r["size"] for r in mine)

    whole = P.run(spark, sf_dir)
    assert sorted(whole.select("doc_id", "taken").collect()) == sorted((r["doc_id"], r["taken"]) for r in mixed)


@pytest.mark.parametrize("empty", [[], ["documents"], ["labels", "benchmark"]])
def test_odd_rows_and_empty_tables(spark, sf_dir, tmp_path, empty):
    import corpus_pipeline as P

    good = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame(ODD, T).unionByName(good).selectExpr("*", "1 as node", "'x' as taken", "2 as size", "'s' as set")
    for name, frame in {"documents": odd, "labels": spark.read.parquet(f"{sf_dir}/labels.parquet"), "benchmark": spark.read.parquet(f"{sf_dir}/benchmark.parquet")}.items():
        (frame.limit(0) if name in empty else frame).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1] if not empty else []:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count() and out.where("text is null or text = ''").count() <= (2 if name != "quality" else 0)
    got = P.run(spark, str(tmp_path)).count() if empty else 0
    assert (got > 0) == ("labels" in empty)
