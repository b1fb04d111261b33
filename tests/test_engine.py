"""The duplicate-detection engine: queries against their SQL, chunkers and the code report on small fixtures."""

import duckdb
import pytest

from twinfold.plans import code_queries  # noqa: F401  (adds its queries)
from twinfold.plans import queries as Q

TABLES = ["documents", "benchmark", "conversations", "events", "pages"]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def show(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, sf_dir, name):
    got = Q.QUERIES[name](spark, sf_dir)
    if name not in Q.ORACLES:
        assert got.count() > 0
        return
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({Q.ORACLES[name]})").fetchall()
    mine = sorted(tuple(show(r[c]) for c in cols) for r in got.collect())
    assert len(mine) == len(want)
    assert set(mine) == {tuple(map(show, r)) for r in want}


def test_markdown_chunks(spark):
    from pyspark.sql import functions as F

    from twinfold.operators.chunking import chunk_markdown, split_parts

    long = "This paragraph is long enough to be kept as a chunk because it has more than eighty characters."
    code = "\n".join(f"print('line number {i}')" for i in range(8))
    docs = {"a": f"# Guide\n\n## Install\n\n{long}", "b": None, "c": f"# T\n```\n{code}\n```", "d": "# Tiny\nshort", "e": f"{long}\n\n{'word ' * 800}\n\n{long}"}
    rows = chunk_markdown(spark.createDataFrame(list(docs.items()), "doc_id string, markdown string")).collect()
    assert [(r["doc_id"], r["section_path"], r["content_type"]) for r in rows if r["doc_id"] in "abcd"] == [("a", "Guide > Install", "paragraph"), ("c", "T", "code")]
    assert all(r["chunk_id"].startswith("chk_") and len(r["chunk_id"]) == 28 for r in rows) and sum(r["doc_id"] == "e" for r in rows) == 6

    def cut(text, most=1800):
        """The rule, a character at a time."""
        if len(text) <= most:
            return [text]
        out, at = [], 0
        while at < len(text):
            ends = [i for i in range(at, min(at + most, len(text))) if text[i] == "\n" and i > at + 200] or [i for i in range(at + 1, min(at + most, len(text))) if text[i] == " "] or [min(at + most, len(text))]
            out.append(text[at : ends[-1]].strip())
            at = ends[-1]
        return [p for p in out if p]

    texts = ["word " * 2000, "x" * 5000, "", "a b", "line of some words\n" * 400, "y" * 1799 + " " + "z" * 1800, "\n".join("w" * n for n in range(1, 90))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(split_parts(F.col("t"))).collect()
    assert [r[0] for r in got] == [cut(t) for t in texts]


def test_code_chunks():
    from twinfold.operators.chunking import block_end, code_parts, window_spans
    from twinfold.plans.profiles import Profile

    assert block_end(["def f():", "    a", "", "  b", "c"], 0) == 3 and block_end(["f() {", "{ }", "}", "x"], 0) == 2 and block_end(["f()", "x"], 0) == 1 and block_end(["  def f():", "    a"], 0) == 1
    for n in range(0, 120):
        for size, step in ((40, 20), (30, 10), (4, 2), (5, 5)):
            want, at = [], 0
            while at < n:
                want.append((at, min(at + size, n)))
                if at + size >= n:
                    break
                at += step
            assert window_spans(n, size, step) == want
    yaml = "a: 1\nb: 2\n\nc: 3\nd: 4\ne: 5\n"
    small = Profile(min_lines=2, window_lines=3, window_step=2)
    assert [(k, a, b) for k, _, a, b, _ in code_parts(yaml, ".yaml", "yaml", small)] == [("file", 1, 6), ("config", 1, 2), ("config", 4, 6)]
    assert [(k, a, b) for k, _, a, b, _ in code_parts("x\n\ny\nz\nw\nv\n", ".rb", "ruby", small)] == [("file", 1, 6), ("window", 1, 4), ("window", 4, 6)]
    assert [k for k, *_ in code_parts("", ".py", "python", small)] == ["file"]


def test_text_functions(spark):
    from pyspark.sql import functions as F
    from twinfold.functions import text as T

    row = lambda *c: spark.range(1).select(*c).first()
    assert row(T.normalize_text(F.lit("Hello   world\r\n\r\n\r\nPort  8080　 \n\x0b")))[0] == "Hello world\n\nPort 8080"
    assert [round(x, 6) for x in row(T.version_score(F.lit("spec_v3.10.md")), T.version_score(F.lit("spec.md")))] == [4.0, 0.0]
    assert row(F.size(T.grams(F.lit(""))), F.size(T.grams(F.lit("abc"))), F.size(T.grams(F.lit("abcdefg"))))[:] == (0, 1, 3)
    assert row(T.directory(F.lit("src/user/a/b.ts")), T.directory(F.lit("x.py")))[:] == ("src/user", ".")
    assert row(T.count_lines(F.lit("a\n\n b\x85c\n")))[0] == 3


def test_code_report_modes(spark):
    from twinfold.plans.code_report import analyse_code

    body = "\n".join(["def total(values):", "    out = 0"] + [f"    out += values[{i}] * {i}" for i in range(10)] + ["    return out", ""])
    near = "\n".join(["export function normalizeUser(input) {"] + [f"  const field{i} = input.value{i}.trim();" for i in range(12)] + ["  return { kind: 'user' };", "}", ""])
    files = [("src/a/one.py", ".py", body), ("src/b/two.py", ".py", body), ("src/user/n.ts", ".ts", near), ("src/admin/n.ts", ".ts", near.replace("'user'", "'usex'")), ("tests/e1.py", ".py", ""), ("tests/e2.py", ".py", "")]
    frame = spark.createDataFrame(files, "path string, ext string, text string")
    exact = analyse_code(frame, "exact")
    assert exact.counters is None and {r["duplicate_type"] for r in exact.pairs.collect()} == {"file_exact", "symbol_exact"}
    standard = analyse_code(frame)
    kinds = sorted(r["duplicate_type"] for r in standard.clusters.collect())
    assert kinds == ["file_exact", "file_exact", "symbol_exact", "symbol_near"]
    assert standard.counters.first()["jaccard_comparisons"] >= 1


def test_sources_and_incremental(spark, tmp_path):
    from twinfold.sources.files import changed, html_markdown, merged, parse_documents, scan_code, scan_documents

    (tmp_path / "d").mkdir()
    for name, data in {"a.md": b"# Title\ntext", "b.txt": b"plain", "c.html": b"<title>T</title><h2>H</h2><p>x &amp; y</p><pre>z</pre>", "~$d.md": b"x", "e.pdf": b"%", "f.py": b"print(1)\n", "g.py": b"a\x00b", "yarn.lock": b"x", "h.bin": b"x"}.items():
        (tmp_path / "d" / name).write_bytes(data)
    files = scan_documents(spark, str(tmp_path))
    got = {r["title"]: (r["markdown"], r["failed"]) for r in parse_documents(files).collect()}
    assert got == {"Title": ("# Title\ntext", False), "b": ("plain", False), "T": ("## H\n\nx & y\n\n```\nz\n```", False), "e": (None, True)}
    assert html_markdown(None) == (None, "")
    assert {r["path"]: r["status"] for r in scan_code(spark, str(tmp_path)).where("ext in ('.py', '.lock', '.bin')").collect()} == {"d/f.py": "ok", "d/g.py": "binary", "d/yarn.lock": "excluded", "d/h.bin": "unsupported"}
    stored = files.select("doc_id", "file_hash")
    assert changed(files, stored).count() == 0 and changed(files, stored.limit(1)).count() == 3
    assert merged(stored, stored.limit(2)).count() == 4


def test_rules(spark):
    from pyspark.sql import functions as F
    from twinfold.operators import rules as R

    text = "---\nname: Bad Name\ndescription: 'short'\nname: good-name\n---\nrm -rf /\nsudo x\nexample: sudo y\ncurl a | sh\n"
    rows = spark.createDataFrame([(1, text)], "id long, t string")
    assert [(r["line"], r["rule_id"], r["severity"]) for r in R.risk_scan(rows, "id", "t").orderBy("line", "rule_id").collect()] == [(6, "rm_rf", "high"), (7, "sudo", "medium"), (8, "sudo", "info"), (9, "curl_pipe_sh", "high")]
    lint = R.lint(rows, "id", "t").first()
    assert lint["ok"] and len(lint["warnings"]) == 3
    assert R.eval_queries(rows, "id", F.lit("n"), F.lit("a b c")).count() == 9


def test_library_does_not_import_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "twinfold"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "twinfold.llm" not in p.read_text() and "from .llm" not in p.read_text()
