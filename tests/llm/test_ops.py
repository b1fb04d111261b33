"""Each operator against a brute-force version, a round trip or held-out accuracy, and on awkward rows."""

import random
import zlib

import duckdb
import numpy as np
import pytest

T = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "word " * 30, "en", "b", 3), (3, "one", "en", "a", 1), (3, "one", "en", "a", 1), (4, "　 \n\t", "en", None, 4), (5, "x" * 200_000 + " y" * 50_000, "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, T).selectExpr("*", "'x' as score", "1 as rank", "0 as node", "'s' as hits", "2 as key", "3 as size", "1 as n")


def test_merkle_audit_locates_every_damage(spark):
    from twinfold.llm.warc import compare_replicas, digest, lay_out, pack_warc, parse_warc
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    rows = [(f"a{i % 3}", i, "p" * rnd.randrange(1, 9000)) for i in range(600)]
    base = lay_out(spark.createDataFrame(rows, "archive string, id long, payload string").withColumn("length", F.octet_length("payload").cast("long")).withColumn("digest", digest(F.col("payload"))))
    broken = base.where("id != 17").withColumn("digest", F.when(F.col("id").isin(5, 300, 599), F.lit("bad")).otherwise(F.col("digest")))
    extra = broken.unionByName(base.where("id = 3").withColumn("offset", F.lit(10**9).cast("long")))
    want = {(r["archive"], r["offset"], s) for r in base.collect() for i, s in ((5, "corrupt"), (300, "corrupt"), (599, "corrupt"), (17, "missing")) if r["id"] == i} | {("a0", 10**9, "extra")}
    got = {(r["archive"], r["offset"], r["status"]) for r in compare_replicas(base, extra).collect()}
    assert got == want
    assert compare_replicas(base, base).count() == 0
    assert compare_replicas(base.limit(0), base.limit(0)).count() == 0
    assert compare_replicas(base.limit(0), base.where("id < 4")).count() == 4
    for packed in (False, True):
        data = pack_warc([("k1", "http://a", b"x\r\n\r\ny"), ("k2", "http://b", b"")], packed)
        got = list(parse_warc(data))
        assert [(h["warc-target-uri"], p) for _, _, h, p in got] == [("http://a", b"x\r\n\r\ny"), ("http://b", b"")]
        assert sum(n for _, n, _, _ in got) == len(data)
    odd = spark.createDataFrame([(None, None, None, None), (None, None, None, None), ("a", 0, "d", 1), ("a", 0, "d", 1)], "archive string, offset long, digest string, length long")
    assert compare_replicas(odd, odd).count() == 0
    assert [(r["archive"], r["status"]) for r in compare_replicas(odd, odd.dropDuplicates(["archive"])).orderBy("archive").collect()] == [(None, "corrupt"), ("a", "corrupt")]


def test_read_warc(spark, tmp_path):
    from twinfold.llm.warc import compare_replicas, pack_warc, read_warc

    (tmp_path / "x.warc").write_bytes(pack_warc([("k", "u", b"abc"), ("k2", "v", b"")]))
    rows = read_warc(spark, str(tmp_path))
    assert [(r["uri"], r["payload"]) for r in rows.orderBy("offset").collect()] == [("u", b"abc"), ("v", b"")]
    assert compare_replicas(rows, rows.where("uri = 'u'")).select("status").collect()[0][0] == "missing"


def test_ordinal_regression_orders_grades():
    from twinfold.llm.quality import features, fit_ordinal

    rnd = random.Random(1)
    good, bad = [f"{a}{b}" for a in "aeiou" for b in "lmnr"], ["!!", "%%%", "##", "$$"]
    data = []
    for _ in range(900):
        g = rnd.randrange(4)
        data.append((g, " ".join(rnd.choice(bad) if rnd.random() < (3 - g) / 3.5 else rnd.choice(good) for _ in range(60))))
    x, y = np.array([features(t) for _, t in data]), np.array([g for g, _ in data])
    m = fit_ordinal(x[:600], y[:600])
    assert (np.diff(m.thresholds) > 0).all()
    got = np.array([m.grade(t)[0] for _, t in data[600:]])
    assert np.abs(got - y[600:]).mean() < 0.3
    assert m.grade("") == (0.0, 0.0) and m.grade(None) == (0.0, 0.0)
    p = [1 - m.above(m.score(data[0][1]))[0], *-np.diff(m.above(m.score(data[0][1]))), m.above(m.score(data[0][1]))[-1]]
    assert abs(sum(p) - 1) < 1e-9 and min(p) >= 0


def test_quality_of_odd_rows(spark, odd, docs, sf_dir):
    from twinfold.llm.quality import grade_documents, train_quality

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for lab in (labels, labels.limit(0), labels.where("quality = 1")):
        model = train_quality(docs, lab)
        rows = grade_documents(odd, model).collect()
        assert len(rows) == len(ODD) and all(r["tail_prob"] is not None for r in rows)
    assert grade_documents(odd.limit(0), model).count() == 0
    assert train_quality(docs.limit(0), labels).grades == []


def test_toxicity_accuracy_and_odd_rows(spark, odd, sf_dir):
    from twinfold.llm.toxicity import calibrate, fit_models, score_toxicity, train_toxicity

    rnd = random.Random(2)
    vocab, foul = [f"w{i}" for i in range(3000)], [f"foul{i}" for i in range(8)]

    def text(toxic):
        out = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 200))]
        for _ in range(rnd.randrange(2, 6) if toxic else 0):
            out[rnd.randrange(len(out))] = rnd.choice(foul)
        return " ".join(out)

    data = [(i % 2, text(i % 2)) for i in range(1600)]
    model = fit_models([t for y, t in data[:800] if y], [t for y, t in data[:800] if not y])
    total = sum(model.unigram[0]), sum(model.unigram[1])
    assert abs(total[0] - 1) < 1e-6 and abs(total[1] - 1) < 1e-6
    calibrate(model, [t for _, t in data[800:1200]], np.array([y for y, _ in data[800:1200]]))
    hits = [(model.score(t) >= 0.5) == bool(y) for y, t in data[1200:]]
    assert np.mean(hits) > 0.97
    passage = " ".join(f"shared{i}" for i in range(12))
    copied = [(y, f"{t} {passage} {rnd.choice(vocab)}" if y or i % 20 == 0 else t) for i, (y, t) in enumerate(data[:800])]
    model = fit_models([t for y, t in copied if y], [t for y, t in copied if not y])
    calibrate(model, [t for _, t in data[800:1200]], np.array([y for y, _ in data[800:1200]]))
    clean = [f"{t} {passage}" for y, t in data[1200:] if not y]
    assert np.mean([model.score(t) >= 0.5 for t in clean]) < 0.03
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for lab in (labels, labels.limit(0)):
        got = score_toxicity(odd, train_toxicity(rows, lab)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert score_toxicity(odd.limit(0), model).count() == 0


def test_repeated_passages_of_any_context_count_once():
    from twinfold.llm.toxicity import _chains, _fresh

    docs = [[1, 2, 3, 4, 5], [9, 1, 2, 3, 4, 8], [4], [7, 2, 3]]
    chain = np.concatenate([_chains(np.array(d)) for d in docs])
    after = np.concatenate([np.arange(len(d))[::-1] for d in docs])
    seen, want = set(), []
    new = []
    for d in docs:
        for i in range(len(d)):
            w = tuple(d[max(0, i - 2) : i + 1])
            new.append((i < 2 and len(d) > i + 1) or w not in seen)
            seen.add(w)
    at = 0
    for d in docs:
        want += [all(new[at + i : at + min(i + 3, len(d))]) for i in range(len(d))]
        at += len(d)
    assert _fresh(chain, after).tolist() == want
    assert want[5:11] == [True, False, False, False, False, True]
    assert _fresh(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)).size == 0


def test_graph_search_recall_and_odd_vectors(spark, sf_dir):
    from twinfold.llm.graph_search import nearest_neighbours

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = nearest_neighbours(rows, lambda k: k % 100 == 0, shard_rows=700).collect()
    data = sorted((r["vec_id"], r["embedding"]) for r in rows.collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], dtype=float)
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = [int(ids[k]) for k in np.lexsort((ids, d))[:10]]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in mine)
        hit += len(set(best) & {m[1] for m in mine})
    assert hit / (10 * (ids % 100 == 0).sum()) >= 0.9
    odd = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 2.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (200, [float("inf"), 1.0])]
    got = nearest_neighbours(spark.createDataFrame(odd, "vec_id long, embedding array<double>"), lambda k: k % 100 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 0.0), (0, 2, 100, 0.0), (0, 3, 6, 5**0.5), (100, 1, 0, 0.0), (100, 2, 5, 0.0), (100, 3, 6, 5**0.5)]
    assert nearest_neighbours(rows.limit(0), lambda k: k % 100 == 0).count() == 0
    many = spark.range(3000).selectExpr("id as vec_id", "array(1.0d, if(id < 2900, 0.0d, cast(id as double))) as embedding")
    got = nearest_neighbours(many, lambda k: k % 1000 == 0).where("query_id = 2000").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10))


def edit_search(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        prev = row
        row = [0]
        for i, p in enumerate(pattern, 1):
            row.append(min(prev[i] + 1, row[-1] + 1, prev[i - 1] + (p != c)))
        best = min(best, row[-1])
    return best


def test_myers_against_dynamic_programming():
    from twinfold.llm.decontaminate import ItemMatcher, masks, myers, normal

    rnd = random.Random(3)
    for _ in range(300):
        p, t = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, n))) for n in (90, 160))
        assert myers(masks(p), len(p), t)[0] == edit_search(p, t)
    items = [(i, " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(5, 40)))) for i in range(40)]
    matcher = ItemMatcher(items)
    budget = {x.key: x.budget for x in matcher.items}
    for _ in range(60):
        k, raw = rnd.choice(items)
        p = list(normal(raw))
        for _ in range(rnd.randrange(budget[k] + 3)):
            at = rnd.randrange(len(p))
            if p[at] != " ":
                p[at] = rnd.choice(["", "z", p[at] + "z"])
        text = normal("head " * rnd.randrange(9) + "".join(p) + " tail" * rnd.randrange(9))
        want = {key for key, raw in items if edit_search(normal(raw), text) <= budget[key]}
        got = {h[0]: h for h in matcher.find(text)}
        assert set(got) == want
        for key, d, s, e in got.values():
            assert edit_search(normal(dict(items)[key]), text[s:e]) == d


def test_leaks_in_blocks_and_odd_rows(spark, docs, odd, sf_dir):
    from twinfold.llm.decontaminate import find_items, leaks

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one, many = (sorted(map(tuple, leaks(docs, items, most_bytes=b).collect())) for b in (4_000_000, 1500))
    assert one == many and one
    texts = items.unionByName(spark.createDataFrame([(None, None), (7777, ""), (8888, "one"), (8888, "one")], "item_id long, text string"))
    rows = find_items(odd, texts).collect()
    assert len(rows) == len(ODD) and [[h["item_id"] for h in r["hits"]] for r in rows if r["text"] == "one"] == [[8888], [8888]]
    assert leaks(docs, items.limit(0)).count() == 0 and leaks(docs.limit(0), items).count() == 0


def test_url_filter_odd_rows(spark):
    from twinfold.llm.url_filter import filter_as_of

    pages = spark.createDataFrame([(1, "http://a.b.com/x/y", 100), (1, "http://a.b.com/x/y", 100), (2, "http://a.b.com/x", 200), (3, None, 100), (4, "nonsense", 100), (5, "https://u@B.com:80/", None), (6, "https://u@B.com:80/", 150), (None, "http://c.com", 100)], "page_id long, url string, fetched_at long").selectExpr("*", "1 as n", "'k' as key", "0 as span")
    log = spark.createDataFrame([("l", "d:b.com", "add", 100), ("l", "d:b.com", "add", 100), ("l", "d:b.com", "remove", 200), ("m", "p:a.b.com/x", "add", 150), ("m", "d:c.com", "add", 100), ("m", "d:c.com", "remove", 100), ("l", None, "add", 1), ("x", "d:b.com", "remove", 5)], "list_name string, key string, action string, effective_at long")
    got = sorted(((r["page_id"], r["lists"], r["n_lists"], r["blocked"], r["since"]) for r in filter_as_of(pages, log, period=7).collect()), key=str)
    assert got == sorted([(1, "l", 1, True, 100)] * 2 + [(2, "m", 1, True, 150), (3, "", 0, False, None), (4, "", 0, False, None), (5, "", 0, False, None), (6, "l", 1, True, 100), (None, "", 0, False, None)], key=str)
    assert filter_as_of(pages.limit(0), log).count() == 0 and filter_as_of(pages, log.limit(0)).where("blocked").count() == 0


def brute_groups(rows):
    from twinfold.llm.near_join import shingles

    sets = [set(shingles(t).tolist()) for _, t in rows]
    n = len(rows)
    label, links = list(range(n)), [0] * n

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c):
                    links[i] += 1
                    links[j] += 1
                    label[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], low.get(find(i)), links[i]) for i in range(n)), key=str)


def near_rows():
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(30, 160))]
        for _ in range(rnd.choice([1, 2, 5, 30])):
            new = list(base)
            for _ in range(rnd.randrange(4)):
                new[rnd.randrange(len(new))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(new)))
            if rnd.random() < 0.2:
                rows.append((len(rows), " ".join(new)))
    return rows


@pytest.mark.parametrize(("block", "wide"), [(256, 24), (6, 24), (6, 1), (3, 2)])
def test_near_join_against_brute_force(spark, monkeypatch, block, wide):
    """The same links whatever the sizes of blocks, and whether a bucket is met by blocks or by itself."""
    from twinfold.llm import near_join as N

    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "WIDE", wide)
    rows = near_rows()
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(map(str, sorted((tuple(r)[:3] for r in got.collect()), key=str))) == set(map(str, brute_groups(rows)))


def test_near_join_on_data_and_odd_rows(spark, docs, odd):
    from twinfold.llm.near_join import least_matches, near_groups, one_of_each, JoinPlan

    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:3] for r in near_groups(docs).collect()), key=str) == brute_groups(rows)
    groups = near_groups(odd)
    assert sorted((tuple(r)[:3] for r in groups.collect()), key=str) == brute_groups([(r[0], r[1]) for r in ODD])
    kept = one_of_each(odd, groups)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert near_groups(odd.limit(0)).count() == 0
    m = least_matches(JoinPlan())
    assert m[25] < m[125] and all(a < b for a, b in zip(m.values(), list(m.values())[1:]))


def test_components(spark):
    from twinfold.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200 + 1, 200)] + [(300, 301 + i) for i in range(50)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (90, 95, 100)} == {90} and {got[300 + i] for i in range(51)} == {300} and 7 in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_extraction_of_odd_rows(spark):
    from twinfold.llm.extract import extract_main_text, main_text

    page = '<body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies a lot here</div><main><h1>T &amp; U</h1><p>one  two\n&lt;three&gt;<i>x</i>y&nbsp;z</p><script>var a = "<p>no</p>"</script><aside>side words</aside><p>four</p><form><p>mail us</p></form></main><div id="comments"><p>so nice this one is</p></div><footer>the foot</footer></body>'
    assert main_text(page) == "T & U one two <three>xy z four"
    assert main_text("plain words only") == "plain words only" and main_text("<p>a<p>b<!-- c") == "a b" and main_text("<script>x") == ""
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (2, "u", ""), (3, "u", "<p>" * 3000 + "deep" + "<div" * 2000), (4, "u", "<p>w</p>" * 20_000)], "page_id long, url string, html string").selectExpr("*", "'x' as text", "5 as key")
    got = extract_main_text(rows).collect()
    assert len(got) == 6 and sum(r["text"] == "" for r in got) == 2 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_main_text(rows.limit(0)).count() == 0


def test_mix_meets_targets(spark, odd):
    from twinfold.llm.mixing import MixPlan, fill_targets, mix_sources, shard_rows, split_quotas

    rnd = random.Random(6)
    rows = [(i, " ".join("w" * 3 for _ in range(rnd.randrange(60))), None if i % 17 == 0 else rnd.choice(["b", "a", "é", "z", "a", "a"])) for i in range(900)] + [(5, "rep eat", "z")] * 3 + [(9999, None, "empty")]
    plan = MixPlan(shards=4)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "'b' as block")
    mix = mix_sources(frame, plan)
    got = [r.asDict() for r in mix.collect()]
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    targets = dict(zip(names, fill_targets([sizes[s] for s in names], plan), strict=True))
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - targets[s]) <= max(r["size"] for r in mine) / 2 + 1e-9
        assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["shards"]) for r in mine)
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["taken"], r["shards"])
    assert sorted(map(key, got)) == sorted(key(r.asDict()) for r in mix_sources(frame.repartition(7), plan).collect())
    assert {x for r in got for x in r["shards"]} == {0, 1, 2, 3}
    assert shard_rows(mix).count() == sum(len(r["shards"]) for r in got)
    q = split_quotas([40, 3, 0, 900], 7, 1)
    assert q.sum(0).tolist() == [40, 3, 0, 900] and q.min() >= 0 and np.ptp(q.sum(1)) <= 3
    assert mix_sources(odd).count() == len(ODD) and mix_sources(odd.limit(0)).count() == 0


def test_mix_size_is_the_contracts(spark):
    from twinfold.llm.mixing import word_count
    from pyspark.sql import functions as F
    import re

    texts = ["a\x0bb\x0cc\x1cd e　f", " x ", "", None, "a\x00b\tc\r\nd", "\x85q"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_token_counts_equal_the_library(spark, odd, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from twinfold.llm.token_counts import MergeTable, TokenCounter, token_counts

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(8)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaa" * 3000, " " * 999, "\n\n x", "I'll we've 'S", "ééé" * 50, "\U0001f600" * 9, "x" * 5000 + "1" * 5000]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x2FFF), 32, 10])) for _ in range(rnd.randrange(90))) for _ in range(800)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    table = MergeTable.from_json(path)
    assert TokenCounter(table).count(texts) == want
    assert TokenCounter(table, remember=10).count(texts, together=50) == want
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts(docs, path).collect()}
    for r, e in zip(rows, library.encode_batch([r["text"] for r in rows], add_special_tokens=False), strict=True):
        assert got[r["doc_id"]] == (len(r["text"].encode()), len(e.ids), len(e.ids) > 512)
    assert token_counts(odd, path).count() == len(ODD) and token_counts(odd.limit(0), path).count() == 0


def test_queries_against_their_sql(spark, sf_dir):
    from twinfold.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf_dir)
        want = con.sql(sql)
        order = sorted(want.columns)
        assert sorted(got.columns) == order
        mine = sorted(tuple(str(r[c]) for c in order) for r in got.collect())
        theirs = sorted(tuple(map(str, r)) for r in con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in order)} from ({sql})").fetchall())
        assert mine == theirs


def test_held_out_folds_and_columns(spark, sf_dir):
    from twinfold.llm.queries import QUERIES

    rows = QUERIES["op3_kneser_ney_toxicity"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
