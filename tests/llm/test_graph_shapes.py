"""Graph search on awkward shapes of data, against all distances."""

import numpy as np
import pytest


def exact(x, q, k=10):
    out = {}
    for i in q:
        top = np.abs(x).max() or 1.0
        d = np.sqrt((((x - x[i]) / top) ** 2).sum(1)) * top
        d[i] = np.inf
        out[i] = (np.lexsort((np.arange(len(x)), d))[: min(k, len(x) - 1)], d)
    return out


def recall(spark, x, every=100, **more):
    from twinfold.llm.graph_search import nearest_neighbours

    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string").selectExpr("*", "7 as rank", "'d' as data", "0 as shard")
    got = {}
    for r in nearest_neighbours(frame, lambda k: k % every == 0, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(x, range(0, len(x), every))
    hit = 0
    for i, (best, d) in want.items():
        mine = got[i]
        assert len(mine) == min(10, len(x) - 1) and [s for _, s in mine] == sorted(s for _, s in mine)
        assert all(s == pytest.approx(d[v], rel=1e-12) for v, s in mine)
        # Rows as near as the tenth count, however ties are broken.
        hit += sum(s <= d[best[-1]] * (1 + 1e-12) for _, s in mine)
    return hit / sum(len(b) for b, _ in want.values())


RND = np.random.default_rng(5)
PLAIN = RND.normal(size=(600, 16))
CENTRES = RND.normal(size=(40, 16)) * 100
SHAPES = {
    "shifted": PLAIN + 1e5,
    "tight": CENTRES[RND.integers(0, 40, 800)] + RND.normal(size=(800, 16)) * 1e-3,
    "large": PLAIN * 1e20,
    "huge": PLAIN * 1e200,
    "tiny": PLAIN * 1e-200,
    "one far": np.concatenate([PLAIN, [np.full(16, 1e20)]]),
    "line": np.arange(1.0, 501.0)[:, None] * np.ones(4),
    "few": PLAIN[:6],
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(spark, name):
    assert recall(spark, SHAPES[name]) >= 0.9
    if len(SHAPES[name]) > 100:
        assert recall(spark, SHAPES[name], shard_rows=200, block=3) >= 0.9


def test_ties_go_to_smaller_ids(spark):
    from twinfold.llm.graph_search import nearest_neighbours

    rows = [(i, [float(i == j) for j in range(200)]) for i in range(200)]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda k: k % 100 == 0).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == list(range(1, 11))
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == list(range(10))


def test_several_shards_of_the_shipped_size(spark):
    assert recall(spark, np.random.default_rng(6).normal(size=(20_000, 32)), every=400) >= 0.9


def test_reverse_edges_all_stay_or_are_pruned_by_distance():
    from twinfold.llm.graph_search import _link_back

    x = np.concatenate([[[0.0, 0.0]], [[np.cos(a), np.sin(a)] for a in np.linspace(0, 6, 300)]]).astype(np.float32)
    near = np.full((301, 12), 301)
    near[1:, 0] = 0
    _link_back(x, near, np.arange(1, 301), 12, 1.2)
    kept = near[0][near[0] < 301]
    angle = np.sort(np.linspace(0, 6, 300)[kept - 1])
    assert 4 <= kept.size <= 12 and np.diff(angle).max() < 2.2  # neighbours on all sides, not those that came first
