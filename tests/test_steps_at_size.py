"""Steps that hold a few rows at a time, or leave rows as they are, against plain forms."""

import numpy as np
from pyspark.sql import functions as F

from twinfold.functions.text import is_normal, normalize_text
from twinfold.operators import pairs as P


def test_texts_pass_as_normal_only_if_they_are(spark):
    odd = ["\r", "\t", "\f", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", "　", " ", "\n", "\n\n\n"]
    texts = ["", "a", "a b\n\nc", "né ü\nß", None, *[f"{x}{m}{y}" for m in odd for x, y in (("", "b"), ("a", ""), ("a", "b"), ("a\n", "b"), ("a", "\nb"), ("é ", "é"))]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", normalize_text(F.col("t")).alias("n"), is_normal(F.col("t")).alias("ok")).collect()
    # The patterns alone: a tab in front and a blank behind, which are stripped, keep texts from passing.
    slow = [r[0] for r in rows.select(normalize_text(F.concat(F.lit("\t\n"), "t", F.lit("\n ")))).collect()]
    assert [r["n"] for r in got] == slow
    assert all(r["t"] == r["n"] for r in got if r["ok"]) and [r["ok"] for r in got[:5]] == [True, True, True, True, None]


def test_windows_are_filtered_before_texts_are_normalised(spark):
    from twinfold.operators.chunking import chunk_code
    from twinfold.plans.profiles import Profile

    files = spark.createDataFrame([(f"p{i}", ".txt", "a\nb\nc\nd\ne" * (i % 3)) for i in range(3000)] + [("p1", ".txt", "a\nb\nc\nd\ne")], "path string, ext string, text string")
    found = chunk_code(files, Profile(min_lines=3, window_lines=4, window_step=2)).where("kind = 'window'").select("path", "line_start", "raw_hash")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.rindex("Filter") and "window" in plan[plan.index("Aggregate") :]
    assert found.count() == found.distinct().count() == 1000 * 2 + 1000 * 4


def test_signatures_and_counts_of_texts_one_at_a_time(spark):
    texts = ["", None, "abc", "abcde" * 3, "x" * 9000, "".join(map(chr, np.random.default_rng(5).integers(97, 120, 6000)))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(P.minhash(F.col("t")).alias("sig"), P.gram_count(F.col("t")).alias("n")).collect()
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 1 << 61, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, 128, dtype=np.uint64)
    for t, r in zip(texts, got, strict=True):
        h = P.gram_hashes(t) if t else np.zeros(1, dtype=np.uint64)
        assert r["sig"] == ((h[:, None] * a + b).min(0) >> np.uint64(2)).astype(np.int64).tolist()
        assert r["n"] == (h.size if t else 0)
    assert isinstance(P.gram_values("abcabcabc"), np.ndarray) and P.gram_values("x" * 9).size == 5


def test_pages_and_documents_leave_their_batch_in_parts(spark):
    from twinfold.operators import chunking
    from twinfold.sources import files

    assert files.ROWS <= 64 and chunking.ROWS <= 256
    pages = spark.createDataFrame([(i, f"<title>t{i}</title><p>p{i}</p>") for i in range(500)], "id long, html string").coalesce(1)
    assert [tuple(r) for r in files.parse_html(pages, "id", "html").collect()] == [(i, f"t{i}", f"p{i}") for i in range(500)]
