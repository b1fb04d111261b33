"""The document engine against a brute-force version, its report, and review hints."""

import random
from itertools import combinations

import pytest

RANK = {"file_exact": 4, "text_exact": 3, "chunk_exact": 2, "chunk_near": 1}


def folder(tmp_path):
    rnd = random.Random(3)
    vocab = [f"term{i}" for i in range(300)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    a, b, c = say(60), say(50), say(45)
    near = a.split()
    near[30] = "changed"
    files = {
        "x/one_v2.md": f"# T\n\n{a}\n\n{b}", "old/two.md": f"# T\n\n{a}\n\n{b}", "x/three.md": f"# T\n\n{a}  \n\n\n{b}", "y/four.txt": f"{' '.join(near)}\n\n{c}", "y/five.txt": f"{say(40)}\n\n{c}\n\n{c}",
        "z/six.md": say(70), "z/tiny.md": "short", "z/bad.pdf": "%PDF",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def brute(keyed, near):
    """Clusters by every pair: (members, type, pairs, mean)."""
    found = {}
    for a, b in combinations(sorted(keyed), 2):
        for kind, key in (("file_exact", "file_key"), ("text_exact", "doc_key"), ("chunk_exact", "text_hash")):
            if keyed[a][key] and keyed[a][key] == keyed[b][key]:
                found[a, b] = (1.0, kind)
                break
        else:
            score = near.get(frozenset((keyed[a]["text_hash"], keyed[b]["text_hash"])))
            if score is not None:
                found[a, b] = (score, "chunk_near")
    label = {x: x for p in found for x in p}
    for _ in label:
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    out = set()
    for root in set(label.values()):
        own = frozenset(x for x in label if label[x] == root)
        scores = [v for p, v in found.items() if p[0] in own]
        out.add((own, max((k for _, k in scores), key=RANK.get), len(scores), round(sum(s for s, _ in scores) / len(scores), 4)))
    return out


@pytest.mark.parametrize("mode", [None, "estimate", "verified"])
def test_clusters_against_brute_force(spark, tmp_path, mode):
    from twinfold.plans import doc_report as D
    from twinfold.sources.files import scan_documents

    files = scan_documents(spark, folder(tmp_path))
    docs, chunks = D.ingest(files)
    keyed = D.keyed_chunks(docs, chunks)
    near = {frozenset((r["ta"], r["tb"])): r["score"] for r in D.near_links(keyed, mode).collect()} if mode else {}
    assert bool(near) == bool(mode)
    report = D.analyse_documents(docs, chunks, mode)
    members = {}
    for r in report.members.collect():
        members.setdefault(r["cluster_id"], set()).add(r["chunk_id"])
    got = {(frozenset(members[r["cluster_id"]]), r["duplicate_type"], r["n_pairs"], r["confidence"]) for r in report.clusters.collect()}
    assert got == brute({r["chunk_id"]: r.asDict() for r in keyed.collect()}, near)
    for r in report.clusters.collect():
        assert r["canonical_chunk_id"] in members[r["cluster_id"]] and r["members"] == len(members[r["cluster_id"]])
    lines = [r["line"] for r in D.report_lines(report).orderBy("cluster_id", "part", "key").collect()]
    assert lines[0].startswith("# Document") and sum(x.startswith("## Cluster") for x in lines) == len(members) and sum(x.startswith("- `chk_") for x in lines) == sum(map(len, members.values()))
    if mode is None:
        best = next(r for r in report.clusters.collect() if r["duplicate_type"] == "file_exact")
        assert best["suggested_action"] == "归档重复文件" and "one_v2.md" in best["summary"]
        assert D.scan_counters(files, files.where("filename = 'six.md'")).first()[:] == (8, 6, 1, 1)
        none = D.analyse_documents(docs.limit(0), chunks.limit(0), "estimate")
        assert none.clusters.count() == 0 and none.members.count() == 0


def test_review_hints(spark):
    from twinfold.operators.review import paths_to_review, review

    rows = [(1, "file_exact", "src/a/x.py", ".py", "file", "python"), (1, "file_exact", "tests/x.py", ".py", "file", "python"), (2, "window_near", "src/a/y.py", ".py", "window", "python"), (2, "window_near", "src/a/z.py", ".py", "window", "python"), (3, "config_duplicate", "d/a.yaml", ".yaml", "config", "yaml")]
    frame = spark.createDataFrame(rows, "cluster long, duplicate_type string, path string, ext string, kind string, language string")
    a, b, c = review(frame).orderBy("cluster").collect()
    assert a["flags"] == ["cross_directory", "file_exact", "file_level_candidate", "low_priority_path", "production_path"] and a["action"] == "review_canonical_candidate" and a["risk"] == "medium" and len(a["doubts"]) == 3
    assert b["flags"] == ["near_duplicate", "production_path", "window_near"] and b["target"] == "src/shared/python_helper" and b["risk"] == "medium" and len(b["blockers"]) == 1
    assert c["must_check"][:2] == ["callers", "deployment_overrides"] and c["risk"] == "high" and len(c["blockers"]) == 2
    assert paths_to_review(frame).count() == 5 and review(frame.limit(0)).count() == 0


def test_eval_cases(spark):
    from pyspark.sql import functions as F

    from twinfold.operators.rules import eval_cases

    got = eval_cases(spark.range(1), "id", F.lit("n"), F.lit("t")).groupBy("kind").count().collect()
    assert dict(map(tuple, got)) == {"positive": 9, "negative": 8, "near_miss": 4}
