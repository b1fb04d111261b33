"""The ordinal model: gradients by differences, several grades, samples that repeat, odd rows."""

import numpy as np


def test_fit_reaches_the_least_loss_of_a_plain_model():
    from twinfold.llm.quality import fit_ordinal

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(600, 4)).astype(np.float32)
    s = x @ np.array([1.5, -1.0, 0.0, 0.5]) + rnd.logistic(size=600)
    y = np.digitize(s, [-1.0, 0.0, 2.0]) + 1
    model = fit_ordinal(x, y, rounds=1500)
    assert model.grades == [1, 2, 3, 4] and (np.diff(model.thresholds) > 0).all()

    def loss(w, theta):
        full = np.concatenate([[-1e9], theta, [1e9]])
        sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -60, 60)))
        z = x @ w
        return -np.log(sig(full[y] - z) - sig(full[y - 1] - z)).mean()

    w, theta = model.weights.copy(), model.thresholds.copy()
    best = loss(w, theta)
    for k in range(4):
        for step in (-0.2, 0.2):
            other = w.copy()
            other[k] += step
            assert loss(other, theta) > best
    for k in range(3):
        for step in (-0.1, 0.1):
            other = theta.copy()
            other[k] += step
            assert loss(w, other) > best
    up = model.above(0.0)
    assert (np.diff(up) < 0).all()


def test_no_labels_clashing_columns_and_reruns(spark):
    from twinfold.llm.quality import grade_documents, train_quality

    rows = [(i, f"good clean text {i}" if i % 2 else f"zz qq {i} xx") for i in range(120)] + [(3, "good other"), (3, "good clean text 3"), (None, "good"), (121, ""), (122, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as expected_grade", "'t' as tail_prob", "2 as selected", "0 as rating", "'h' as h")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    models = [train_quality(d, labels, most_rows=50) for d in (docs, docs.repartition(5), docs.repartition(2))]
    assert all(np.array_equal(m.weights, models[0].weights) and np.array_equal(m.thresholds, models[0].thresholds) for m in models)
    got = grade_documents(docs, models[0]).collect()
    assert len(got) == len(rows) and all(0 <= r["tail_prob"] <= 1 and r["selected"] == (r["tail_prob"] >= 0.5) for r in got)
    assert all(r["tail_prob"] == 0 and not r["selected"] for r in got if not r["text"])
    none = grade_documents(docs, train_quality(docs, labels.limit(0))).collect()
    assert all(r["selected"] == bool(r["text"]) and r["expected_grade"] is None for r in none)
    assert grade_documents(docs.limit(0), models[0]).count() == 0
