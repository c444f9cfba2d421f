"""FEAST and whitening against numpy."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import whitening as wh
from caseflow.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def symmetric(seed, size, spread):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    a = q @ np.diag(spread) @ q.T
    return (a + a.T) / 2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 24))
def test_inertia_counts_eigenvalues(seed, size):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(size, size))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    for shift in rng.normal(size=4) * 3:
        assert wh.inertia(a, shift) == (values < shift).sum()
    # no usable diagonal: blocks of two rows are taken
    b = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert wh.inertia(b, 0.0) == 1


@pytest.mark.parametrize("spread", [
    np.linspace(0.1, 9, 64), np.r_[np.ones(30) * 5, np.ones(34)], np.r_[np.zeros(60), 1, 2, 3, 4.0],
    10.0 ** -np.arange(0, 12.8, 0.2), np.repeat([3, 2, 1, 0.5], 16), np.ones(64), np.ones(5), np.array([2.0]),
    np.r_[1 + 1e-9 * np.arange(20), np.linspace(0, 0.5, 20)]])
def test_largest_pairs(spread):
    a = symmetric(3, len(spread), spread)
    values, vectors = wh.largest(a, 32)
    want = np.sort(spread)[::-1][:32]
    assert np.abs(values - want).max() <= 1e-12 * spread.max()
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-11 * spread.max()


def test_intervals_hold_what_is_asked_for():
    a = symmetric(4, 50, np.linspace(1, 2, 50))
    parts = wh.intervals(a, 20)
    values = np.linalg.eigvalsh(a)
    assert sum(n for _, _, n in parts) >= 20 and all(n <= wh.PER_INTERVAL for _, _, n in parts)
    assert all(((values >= lo) & (values < hi)).sum() == n for lo, hi, n in parts)


def plain(vectors, k=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)) + 1_000_000
    c = x - x.mean(0)
    v = c.T @ c / len(x)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return c @ u / np.sqrt(e), e / np.trace(v)


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_feast_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"], kind="stable")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    assert len(got) == 32 * len(rows) and got.n.eq(len(rows)).all()
    w, explained = plain([r.embedding for r in rows])
    mine = got.whitened.to_numpy().reshape(-1, 32)
    assert np.abs(mine * np.sign((w * mine).sum(0)) - w).max() < 1e-9
    assert np.abs(got.explained.to_numpy()[:32] / explained - 1).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in r.embedding] for r in rows], dtype=object)
    deviation = ((len(rows) * x - x.sum(0)) ** 2).sum(1)
    assert got.deviation.to_numpy()[::32].tolist() == deviation.tolist()


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]),
           (104, []), (None, [0.5, 0.5, 0.5]), (7, good[7][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + odd], SCHEMA + ", n string, component int")
    out = wh.whiten(df, wh.fit(df)).collect()
    assert len(out) == 42 and {r.vec_id for r in out} == {*range(40), None} and {r.n for r in out} == {42}
    assert all(len(r.components) == 3 for r in out) and out[0].identity_error < 1e-9
    twice = [r for r in out if r.vec_id == 7]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_two_dimensions_are_two_fit_lists(spark):
    rows = [(i, [float(i % 5), float(i % 3), float(i % 7)]) for i in range(30)] + [(100 + i, [float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: r for r in wh.whiten(df, wh.fit(df)).collect()}
    assert got[0].n == 30 and len(got[0].components) == 3 and got[100].n == 4 and len(got[100].components) == 1
    assert abs(got[100].components[0].explained - 1) < 1e-12


def test_no_variance_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], SCHEMA)
    out = wh.whiten(same, wh.fit(same)).collect()
    assert len(out) == 5 and all(r.components == [] and r.deviation == 0 for r in out)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], SCHEMA)
    assert {len(r.components) for r in wh.whiten(line, wh.fit(line)).collect()} == {1}
    none = spark.createDataFrame([], SCHEMA)
    assert wh.fit(none) == {} and wh.whiten(none, {}).count() == 0


def test_large_values_stay_exact(spark):
    rows = [(0, [1e15, -1e15]), (1, [2e15, 3.0]), (2, [3.0, 5e15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: int(r.deviation) for r in wh.whiten(df, wh.fit(df)).collect()}
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    want = ((3 * x - x.sum(0)) ** 2).sum(1)
    assert got == dict(enumerate(want.tolist()))
