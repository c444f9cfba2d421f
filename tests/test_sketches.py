"""Stored sketches: merged days answer like the whole, within the bound."""

from __future__ import annotations

import numpy as np
import pytest
from golden import golden_log
from pyspark.sql import functions as F

from caseflow.model import REFERENCE_MODEL as M
from caseflow.operators import cases as cs
from caseflow.operators import sketches as sk

PROBS = {"low": 0.01, "q1": 0.25, "median": 0.5, "p90": 0.9, "high": 0.999}


def values(spark, n=200_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("activity"),
        F.timestamp_seconds(F.col("id") * 37 % 2_000_000).cast("timestamp_ntz").alias("ts"),
        (F.pow(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 1000.0, F.lit(2.0))).alias("w"))


def test_merged_days_stay_within_the_bound(spark):
    df = values(spark)
    daily = sk.daily_quantile_sketches(df, "w", ["activity"])
    assert daily.count() > 100 and daily.columns == ["activity", "day", "sketch"]
    merged = sk.merged_quantile_sketches(daily, ["activity"])
    answers = sk.sketch_quantiles(merged, PROBS)
    got = sk.rank_checked(df, "w", ["activity"], answers, PROBS).collect()
    count = {r.activity: r[1] for r in df.groupBy("activity").count().collect()}
    assert {r.activity: r.n for r in got} == count
    assert all(r[f"{p}_ok"] for r in got for p in PROBS)
    # two levels of merging, and all groups as one
    weekly = sk.merged_quantile_sketches(daily.withColumn("week", F.weekofyear("day")), ["week"])
    whole = sk.sketch_quantiles(sk.merged_quantile_sketches(weekly.withColumn("a", F.lit(1)), ["a"]), PROBS).first()
    exact = np.array([r.w for r in df.select("w").collect()])
    assert whole.n == len(exact)
    for p, q in PROBS.items():
        assert (exact < whole[p]).mean() - sk.RANK_ERROR <= q <= (exact <= whole[p]).mean() + sk.RANK_ERROR


def test_a_wrong_answer_is_told(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("w"))
    told = lambda x: sk.rank_checked(df, "w", ["g"], spark.createDataFrame([("g", float(x))], "g string, m double"),
                                     {"m": 0.5}).first().m_ok
    assert told(500) and told(512) and told(488) and not told(530) and not told(470)


def test_sketch_size_does_not_grow(spark):
    size = [sk.quantile_sketches(values(spark, n), "w", []).select(F.length("sketch")).first()[0] for n in (20_000, 400_000)]
    assert size[1] < 2 * size[0] < 40_000


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None)], "g string, w double")
    got = sk.sketch_quantiles(sk.quantile_sketches(df, "w", ["g"]), {"m": 0.5}).collect()
    assert [tuple(r) for r in got] == [("b", 1, 1.0)]
    assert sk.quantile_sketches(df.where("g = 'z'"), "w", ["g"]).count() == 0


def test_distinct_of_cases_and_of_all(spark):
    log = golden_log(spark)
    daily = sk.daily_distinct_sketches(log)
    want = {r.case_id: (r.n_unique_activities, r.n_resources) for r in cs.case_aggregates(log, M).collect()}
    got = {r.case_id: (r.n_unique_activities, r.n_resources) for r in sk.distinct_counts(daily, ["case_id"]).collect()}
    assert got == want
    both = {r.case_id: (r.n_unique_activities, r.n_resources) for r in
            cs.case_aggregates(log, M, approx_resources=True, approx_activities=True).collect()}
    assert both == want
    whole = sk.distinct_counts(daily).first()
    assert tuple(whole) == (log.select("activity").distinct().count(), log.where("resource is not null").select(
        "resource").distinct().count())


@pytest.mark.parametrize("n", [100_000])
def test_many_distinct_values_within_error(spark, n):
    log = spark.range(n).select(F.lit("c").alias("case_id"), F.concat(F.lit("a"), F.col("id") % 7).alias("activity"),
                                F.concat(F.lit("u"), F.col("id")).alias("resource"),
                                F.timestamp_seconds(F.col("id") * 100).cast("timestamp_ntz").alias("ts"))
    got = sk.distinct_counts(sk.daily_distinct_sketches(log), ["case_id"])
    row = got.withColumn("ok", sk.within("n_resources", F.lit(n), 0.05)).first()
    assert row.n_unique_activities == 7 and row.ok
