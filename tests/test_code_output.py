"""What the code engine reports of whole runs."""

import json

import pytest


def tree(tmp_path):
    """A folder with equal files, near functions, equal configs, and files of every status."""
    body = "\n".join(["def total(values):", "    out = 0"] + [f"    out += values[{i}] * {i}" for i in range(12)] + ["    return out", ""])
    near = "\n".join(["export function normalizeUser(input) {"] + [f"  const field{i} = input.value{i}.trim();" for i in range(14)] + ["  return { kind: 'user' };", "}", ""])
    conf = "\n".join(f"key{i}: value{i}" for i in range(14)) + "\n"
    files = {
        "src/a/one.py": body, "src/b/two.py": body, "src/user/n.ts": near, "src/admin/n.ts": near.replace("'user'", "'usex'"), "conf/a.yaml": "# first\n\n" + conf, "conf/b.yaml": conf, "tests/t.py": "x = 1\n",
        "node_modules/x/i.js": "skip\n", "src/a/big.py": "#" * 3000, "src/a/z.min.js": "m", "notes.txt": "text", "LICENSE": "words", "src/bin.py": "a\0b", "src/p|q.py": "y = 2\n", "src/a/c.pyc": "c",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "src/latin.py").write_bytes(b"caf\xe9 = 1\n")
    return str(tmp_path)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    from twinfold.plans import code_report as R
    from twinfold.sources.files import scan_code

    root = tree(tmp_path_factory.mktemp("code"))
    scanned = scan_code(spark, root, max_kb=2).cache()
    report = R.analyse_code(scanned.where("status = 'ok'").select("path", "ext", "text"))
    return scanned, report, R.run_metadata(spark, root, report, max_kb=2)


def test_scan_names_what_it_leaves_out(run):
    from twinfold.sources import files as S

    scanned, _, _ = run
    status = {r["path"]: r["status"] for r in scanned.collect()}
    assert status["node_modules/x/i.js"] == "excluded_folder" and status["src/a/big.py"] == "too_large" and status["src/bin.py"] == "binary" and status["src/a/z.min.js"] == "excluded" and status["notes.txt"] == "unsupported"
    assert {r[0] for r in S.ignored_files(scanned).collect()} == {"src/a/big.py (too large)", "src/bin.py (binary)", "src/a/z.min.js"}
    assert [r[0] for r in S.ignored_folders(scanned).collect()] == ["node_modules/x"] or [r[0] for r in S.ignored_folders(scanned).collect()] == ["node_modules"]
    assert [tuple(r) for r in S.unsupported(scanned).collect()] == [("(no extension)", 1), (".txt", 1)] and S.total_unsupported(scanned).first()[0] == 2
    assert scanned.where("path = 'src/latin.py'").first()["text"] == "caf = 1\n"


def test_report_has_nine_sections_and_all_clusters(run, tmp_path):
    from twinfold.plans import code_report as R

    scanned, report, meta = run
    for _ in range(2):
        R.write_reports(scanned, report, meta, str(tmp_path))
    read = lambda name: [json.loads(x) for p in sorted((tmp_path / "report.json" / name).glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]
    clusters = read("clusters")
    assert len(clusters) == report.clusters.count() >= 4 and {c["duplicate_type"] for c in clusters} >= {"file_exact", "symbol_exact", "symbol_near", "config_duplicate"}
    assert all(c["merge_plan"]["steps"] and c["agent_steps"] and c["calls"]["checks"] and c["difference"]["similarities"][0] == c["reason"] for c in clusters)
    shared = next(c for c in clusters if c["duplicate_type"] == "symbol_exact")
    assert shared["merge_plan"]["steps"][1] == "抽取公共实现到 `src/shared/python_shared`。" and shared["agent_steps"][0] == "读取重复簇涉及文件：src/a/one.py, src/b/two.py。"
    summary = read("summary")[0]
    assert summary["duplicate_clusters"] == len(clusters) and summary["files_ignored"] == 3 and summary["files_scanned"] == 9
    assert read("run")[0]["effective_threshold"] == 0.86 and read("run")[0]["tool"]["mode"] == "read_only_analysis"
    members = read("members")
    assert [(m["cluster_id"], m["path"], m["line_start"]) for m in members] == sorted((m["cluster_id"], m["path"], m["line_start"]) for m in members) and len(members) == report.members.count()
    assert len(read("pairs")) == report.pairs.count() and {(d["cluster_id"], d["folder"]) for d in read("directories")} == {(m["cluster_id"], "/".join(m["path"].split("/")[:-1][:2]) or ".") for m in members}
    folders = read("folders")
    assert folders == sorted(folders, key=lambda f: (-f["duplicate_clusters"], -f["duplicate_lines"], f["folder"]))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "report.md").glob("part-*")).splitlines()
    assert [x[3] for x in text if x.startswith("## ")] == list("123456789") and text[0] == "# 代码重复检测报告"
    assert f"| 扫描文件数 | {summary['files_scanned']} |" in text and "| `(no extension)` | 1 |" in text
    shown = [x[4:] for x in text if x.startswith("### ")]
    high = [c["cluster_id"] for c in sorted(clusters, key=lambda c: (-c["score"], c["cluster_id"])) if c["priority"] == "high"]
    medium = [c["cluster_id"] for c in sorted(clusters, key=lambda c: (-c["score"], c["cluster_id"])) if c["priority"] == "medium"][:5]
    assert shown == (high or medium) and shown
    low = [c for c in clusters if c["priority"] == "low"]
    assert f"- 低优先级重复簇数量：{len(low)}" in text


def test_empty_run_says_so(spark, tmp_path):
    from twinfold.plans import code_report as R
    from twinfold.sources.files import scan_code

    (tmp_path / "a.txt").write_text("x")
    scanned = scan_code(spark, str(tmp_path))
    report = R.analyse_code(scanned.where("status = 'ok'").select("path", "ext", "text"), "exact")
    lines = [r["line"] for r in R.report_lines(scanned, report, R.run_metadata(spark, str(tmp_path), report)).orderBy("s", "t", "x", "y", "z", "u").collect()]
    assert "| 无 | 无 | 无 | 无 | 0 | 0 | 否 |" in lines and "| N/A | 0 |" in lines and sum("`EXACT_MODE" in x or "`NO_SUPPORTED" in x for x in lines) == 2


def test_cap_marks_the_first_pairs_of_a_fixed_order(spark):
    from twinfold.operators.pairs import capped

    pairs = spark.range(200).selectExpr("cast(id % 7 as string) as left", "cast(id as string) as right")
    got = capped(pairs, 60, ["left", "right"]).collect()
    first = sorted((r["left"], r["right"]) for r in got)[:60]
    assert {(r["left"], r["right"]) for r in got if r["compared"]} == set(first) and len(got) == 200
    assert not any(r["compared"] for r in capped(pairs, 0, ["left", "right"]).collect())


def test_positional_ids_over_ranges(spark):
    from twinfold.operators.clusters import numbered

    got = numbered(spark.range(1200).selectExpr("concat('c', lpad(cast(id as string), 5, '0')) as cluster"), "cluster").orderBy("cluster").collect()
    assert [r["cluster_id"] for r in got] == [f"cluster_{i:03d}" for i in range(1, 1201)]


def test_counters_say_when_the_cap_is_passed(spark):
    from pyspark.sql import functions as F

    from twinfold.operators.clusters import quality_warnings
    from twinfold.plans.code_report import analyse_code
    from twinfold.plans.profiles import Profile

    text = "\n".join(["export function f(input) {", *[f"  const field{i} = input.value{i}.trim();" for i in range(13)], "  return 1;", "}", ""])
    files = spark.createDataFrame([(f"src/{k}/n.ts", ".ts", text.replace("return 1", f"return {k}")) for k in range(3)], "path string, ext string, text string")
    whole = analyse_code(files)
    n = whole.counters.first()["jaccard_comparisons"]
    for most, capped in ((n, False), (n - 1, True)):
        got = analyse_code(files, base=Profile(max_comparisons=most))
        assert got.counters.first()["capped"] is capped and got.pairs.count() == whole.pairs.count()
        stats = got.counters.select(F.lit(3).alias("files"), F.lit(1).alias("clusters"), F.lit(0).alias("unsupported"), F.lit(0).alias("ignored"), "capped", F.lit(False).alias("only_tests"))
        assert ("MAX_COMPARISONS_REACHED" in {r["code"] for r in quality_warnings(stats, "standard").collect()}) is capped
