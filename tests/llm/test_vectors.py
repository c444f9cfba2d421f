"""Exact top-k and learned partitions against brute force."""

import numpy as np
import pytest
from pyspark.sql import types as T

from caseflow.llm import topk
from caseflow.llm.ann import balanced_parts, learn, nearest, rerank, search
from caseflow.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("score", T.StringType()), T.StructField("key", T.LongType())])


def brute(rows, k, step, score, better):
    out = []
    for q, v in rows:
        if q % step == 0:
            found = sorted(((better * score(v, w), c) for c, w in rows if c != q and len(w) == len(v)))[:k]
            out += [(q, r + 1, c, better * s) for r, (s, c) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_pruned_search_equals_brute_force(spread):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 16))
    x = centre[rng.integers(0, 6, 3000)] + spread * rng.normal(size=(3000, 16))
    x *= rng.lognormal(0, 1, 3000)[:, None]
    v = topk.quantised(x, 256.0)
    order = np.lexsort((np.arange(3000), -np.sqrt((v.astype(float) ** 2).sum(1))))
    best = topk.search(np.arange(0, 3000, 50), v[::50], order, v[order], 5)
    scores = v[::50] @ v.T
    for i, q in enumerate(range(0, 3000, 50)):
        s = scores[i].astype(object)
        want = sorted(((-s[c], c) for c in range(3000) if c != q))[:5]
        assert list(zip((-best.scores[i]).tolist(), best.ids[i].tolist())) == want


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], "x", 1), (1, [0.5, 0.25], "x", 1), (2, [0.5, 0.25], None, 1), (50, [-1.0, 0.0], "x", 1),
            (3, None, "x", 1), (4, [1.0, None], "x", 1), (5, [nan, 1.0], "x", 1), (6, [inf, 1.0], "x", 1),
            (None, [1.0, 1.0], "x", 1), (7, [0.0, 0.0], "x", 1), (8, [1.0, 2.0, 3.0], "x", 1), (100, [], "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    fine = [(i, v) for i, v, _, _ in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in fine]
    want = brute(ints, 5, 50, lambda a, b: sum(x * y for x, y in zip(a, b)), -1)
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id % 50 = 0").collect())
    assert got == want
    got = sorted(tuple(r) for r in search(df, "vec_id % 50 = 0", k=10).collect())
    own = [(i, v) for i, v in fine if len(v) == 2 and any(v)]
    want = brute(own, 10, 50, lambda a, b: float(np.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))), 1)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    empty = df.limit(0)
    assert topk.top_k(empty, "vec_id % 50 = 0").collect() == []
    assert search(empty, "vec_id % 50 = 0").collect() == []
    assert topk.top_k(df, "vec_id = -1").collect() == []


def test_wide_scores_are_exact():
    q = np.array([[2 ** 40, -(2 ** 41)]], dtype="<i8")
    assert topk.products(q, q, False)[0, 0] == np.iinfo(np.int64).max
    assert topk.products(np.array([[2 ** 30, 3]]), np.array([[2 ** 30, 5]]), False)[0, 0] == 2 ** 60 + 15


def test_balanced_parts_and_rerank():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1600, 8))
    near = nearest(x, 10)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (np.sort(near, 1) == np.sort(np.argsort(d, 1)[:, :10], 1)).all()
    part = balanced_parts(near, 3, rng)
    assert np.bincount(part).tolist() == [200] * 8
    assert (part[near] == part[:, None]).mean() > 2 / 8  # better than chance
    found = rerank(np.arange(4), x[:4], np.arange(1600), x, 10)
    assert [f[1] for f in found[:10]] == np.argsort(d[0], kind="stable")[:10].tolist()


def test_recall_is_at_least_nine_tenths(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 24))
    x = centre[rng.integers(0, 40, 6000)] + 0.6 * rng.normal(size=(6000, 24))
    router, probes = learn(x[:4000])
    assert router is not None and probes < 32
    df = spark.createDataFrame([(i, v.tolist(), None, 0) for i, v in enumerate(x)], SCHEMA)
    got = search(df, "vec_id % 100 = 0").toPandas()
    hit = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, d[own.vec_id])
        hit += len(set(own.vec_id) & set(np.argsort(d)[:10].tolist()))
    assert hit / 600 >= 0.9


def test_queries_run_over_the_table(spark):
    got = QUERIES["op3_norm_bucketed_top_k"](spark, SF01)
    assert [f.name for f in got.schema] == ["query_id", "rank", "vec_id", "score"]
    assert got.count() == 50
    assert QUERIES["op10_learned_partitions"](spark, SF01).count() == 50
