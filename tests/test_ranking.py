"""Distributed positions/quantiles/running sums against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from caseflow.operators.ranking import positions, quantiles, running_sums


def test_positions_match_sorted_order(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("abc"), rnd.randint(0, 50), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = positions(df, [F.desc("v"), "id"], ["g"], name="p", total="n").collect()
    for g in "abc":
        mine = sorted((r["p"], r["v"], r["id"]) for r in got if r["g"] == g)
        want = sorted([(v, i) for gg, v, i in rows if gg == g], key=lambda t: (-t[0], t[1]))
        assert [(v, i) for _, v, i in mine] == want
        assert [p for p, _, _ in mine] == list(range(1, len(want) + 1))


def test_positions_hot_group_spreads(spark):
    # one group holds most rows; it must still be ranked exactly
    rows = [("hot", i) for i in range(2000)] + [("cold", i) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = positions(df, ["v"], ["g"], name="p", num_partitions=8)
    bad = got.filter("p <> v + 1").count()
    assert bad == 0


def test_quantiles_equal_numpy(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("xy"), rnd.gauss(10, 4)) for _ in range(777)] + [("x", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    q = {r["g"]: r for r in quantiles(df, "v", {"p25": .25, "med": .5, "p90": .9}, ["g"]).collect()}
    for g in "xy":
        vals = [v for gg, v in rows if gg == g and v is not None]
        for k, p in (("p25", 25), ("med", 50), ("p90", 90)):
            assert abs(q[g][k] - np.percentile(vals, p)) < 1e-9


def test_running_sums(spark):
    rows = [(i * 0.5, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "s double, x long")
    got = running_sums(df, [F.desc("s")], ["x"]).collect()
    want = np.cumsum([x for _, x in sorted(rows, key=lambda t: -t[0])])
    got_sorted = [r["cum_x"] for r in sorted(got, key=lambda r: -r["s"])]
    assert got_sorted == list(want)


def test_sketch_quantiles_close_to_exact(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice("ab"), rnd.uniform(0, 100)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    ex = {r["g"]: r["m"] for r in quantiles(df, "v", {"m": .5}, ["g"]).collect()}
    ap = {r["g"]: r["m"] for r in quantiles(df, "v", {"m": .5}, ["g"], exact=False,
                                             extra={"n": F.count}).collect()}
    for g in "ab":
        assert abs(ex[g] - ap[g]) < 1.0


def test_quantiles_of_ties_signs_and_extremes(spark):
    """Half of the values tie; zeros, negative, tiny and huge ones."""
    rnd = random.Random(5)
    rows = [("big", rnd.choice([0.0, float(i % 97), -float(i % 13), 1e-300 * i, 1e300 * i]))
            for i in range(1, 1500)]
    rows += [("tied", 4.25)] * 500 + [("one", -3.5), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0, "m": .5, "p9": .9, "p1": 1}
    got = {r["g"]: r for r in quantiles(df, "v", probs, ["g"], extra={
        "n": F.count, "mean": F.avg, "total": F.sum}).collect()}
    for g in ("big", "tied", "one", None):
        vals = [v for gg, v in rows if gg == g]
        for k, p in probs.items():
            assert np.isclose(got[g][k], np.percentile(vals, 100 * p), rtol=1e-12, atol=0)
        assert got[g]["n"] == len(vals) and np.isclose(got[g]["mean"], np.mean(vals))
    glob = quantiles(df, "v", {"m": .5}).first()["m"]
    assert np.isclose(glob, np.percentile([v for _, v in rows], 50))


def test_building_a_quantile_starts_no_job(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id as double) as v")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy-quantiles", "no job expected")
    try:
        q = quantiles(df, "v", {"m": .5}, ["g"])
        assert list(tracker.getJobIdsForGroup("lazy-quantiles")) == []
        assert q.count() == 3
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_half_tied_values_make_no_hot_window(spark):
    """The rows that windows and joins see are distinct values, so a value
    that half of the rows hold is one row there."""
    df = spark.range(40_000).selectExpr("id % 3 as g", "if(id % 2 = 0, 0.0, cast(id as double)) as v")
    q = quantiles(df, "v", {"m": .5}, ["g"])
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "partial_count" in plan and "SinglePartition" not in plan
    for r in q.collect():
        want = np.percentile([0.0 if i % 2 == 0 else float(i) for i in range(40_000) if i % 3 == r.g], 50)
        assert r.m == want
