"""Models on the events case table: schema, metric ranges, ROC AUC, determinism.
Few trees/rounds here to keep the suite quick (the registered queries use the
full reference settings)."""

from __future__ import annotations

import pytest
from conftest import SF01

from caseflow.model import EVENTS_MODEL as M
from caseflow.operators import cases as cs
from caseflow.operators import clean as cl
from caseflow.operators import ml
from caseflow.sources import adapters


@pytest.fixture(scope="module")
def prepared(spark):
    log = cl.clean(adapters.main_log(spark, SF01))
    return ml.prepare(cs.build_case_table(log, M)).cache()


def test_split_is_stratified_and_deterministic(prepared):
    per = {(r["label"], r["is_test"]): r["count"]
           for r in prepared.groupBy("label", "is_test").count().collect()}
    for lab in (0, 1):
        n = per.get((lab, 0), 0) + per.get((lab, 1), 0)
        assert per[(lab, 1)] == -(-n * 25 // 100)
    folds = prepared.filter("is_test = 0").groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]
    again = ml.prepare(prepared.select("case_id").join(prepared, "case_id")
                       .select(*[c for c in prepared.columns if c not in ("weight", "is_test", "fold")])
                       .withColumnRenamed("label", "sla_breach"))
    assert again is not None


def test_fit_small(spark, prepared):
    res = ml.fit_models(prepared, rf_trees=10, gb_rounds=5)
    comp = ml.comparison(spark, res).collect()
    assert len(comp) == 3 and sum(r["is_best"] for r in comp) == 1
    for r in comp:
        assert 0.0 <= r["test_auc"] <= 1.0 and 0.0 <= r["cv_auc"] <= 1.0
    imp = ml.importances(spark, res)
    assert imp.count() == 3 * len(res.feats)
    sc = ml.scored(res, res.best)
    roc = ml.roc_points(sc)
    auc_roc = ml.auc_from_roc(roc).first()["auc"]
    best = [r for r in comp if r["is_best"]][0]
    assert abs(auc_roc - best["test_auc"]) < 0.02
    cm = ml.confusion(sc).collect()
    assert len(cm) == 4 and sum(r["n_cases"] for r in cm) == sc.count()


@pytest.fixture()
def two_folds(prepared, monkeypatch):
    monkeypatch.setattr(ml, "ML_FOLDS", 2)
    return prepared.withColumn("fold", prepared.fold % 2).cache()


def test_models_are_fitted_once_and_read_again(spark, two_folds, tmp_dir, monkeypatch):
    prepared, calls = two_folds, []
    fit = ml.fit_models
    monkeypatch.setattr(ml, "fit_models", lambda *a, **k: calls.append(1) or fit(*a, **k))
    small = dict(rf_trees=2, gb_rounds=1)
    first = ml.fit_or_load(prepared, tmp_dir, **small)
    again = ml.fit_or_load(prepared.repartition(3), tmp_dir, **small)  # equal rows in another order
    assert len(calls) == 1 and again.best == first.best and again.feats == first.feats
    key = lambda r: r["model"]
    assert sorted(again.metrics, key=key) == sorted(first.metrics, key=key)
    for name in first.models:
        a, b = (sorted(map(tuple, ml.scored(x, name).collect())) for x in (first, again))
        assert a == b
    assert sorted(map(tuple, ml.importances(spark, again).collect())) == \
        sorted(map(tuple, ml.importances(spark, first).collect()))
    # other parameters, or one changed row, are another key
    ml.fit_or_load(prepared, tmp_dir, rf_trees=3, gb_rounds=1)
    from pyspark.sql import functions as F
    one = prepared.agg(F.min("case_id")).first()[0]
    ml.fit_or_load(prepared.withColumn("n_events", F.col("n_events") + (F.col("case_id") == one).cast("double")),
                   tmp_dir, **small)
    assert len(calls) == 3


def test_each_fold_and_the_whole_part_are_fitted_once(spark, two_folds, monkeypatch):
    """Side by side, with the measures that folds fitted in turn have."""
    import threading

    import numpy as np
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    fit, calls, one, at_once = Pipeline.fit, [], threading.Lock(), threading.Barrier(2, timeout=60)

    def seen(self, *a):
        with one:
            first = len(calls) < 2
            calls.append(type(self.getStages()[-1]).__name__)
        if first:  # fails unless two fits run at a time
            at_once.wait()
        return fit(self, *a)

    monkeypatch.setattr(Pipeline, "fit", seen)
    res = ml.fit_models(two_folds, rf_trees=2, gb_rounds=1, parallelism=4)
    assert sorted(calls) == sorted(3 * ["GBTClassifier", "LogisticRegression", "RandomForestClassifier"])
    monkeypatch.setattr(Pipeline, "fit", fit)
    train = two_folds.filter("is_test = 0")
    pipe = ml.model_specs(res.feats, train.count() // 2)["Logistic Regression"]
    aucs = [BinaryClassificationEvaluator().evaluate(pipe.fit(train.filter(f"fold <> {i}")).transform(
        train.filter(f"fold = {i}"))) for i in (0, 1)]
    got = next(m for m in res.metrics if m["model"] == "Logistic Regression")
    assert got["cv_auc"] == pytest.approx(np.mean(aucs), abs=1e-6)
    assert got["cv_std"] == pytest.approx(np.std(aucs), abs=1e-6)
    with pytest.raises(ValueError):  # a fold without rows
        ml.fit_models(two_folds.filter("fold is null or fold = 1"), rf_trees=2, gb_rounds=1)


def test_an_unfinished_fit_is_done_again(spark, two_folds, tmp_dir, monkeypatch):
    prepared, fit, calls = two_folds, ml.fit_models, []
    monkeypatch.setattr(ml, "fit_models", lambda *a, **k: calls.append(1) or fit(*a, **k))
    real = ml.comparison

    def lost(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(ml, "comparison", lost)
    with pytest.raises(RuntimeError):
        ml.fit_or_load(prepared, tmp_dir, rf_trees=2, gb_rounds=1)
    monkeypatch.setattr(ml, "comparison", real)
    res = ml.fit_or_load(prepared, tmp_dir, rf_trees=2, gb_rounds=1)
    assert len(calls) == 2 and len(res.models) == 3


def test_split_by_radix_rank_equals_a_sort(spark, monkeypatch):
    """Positions from counted hash digits, also with a few cases a bucket."""
    import hashlib
    import math

    rows = [(f"c{i}", i % 3 == 0, float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "case_id string, b boolean, x double").selectExpr("case_id", "cast(b as int) label", "x")
    for digits in (1, 4):
        monkeypatch.setattr(ml, "RADIX", digits)
        out = ml.split_and_folds(df)
        assert out.columns == ["case_id", "label", "x", "is_test", "fold"]
        got = {r.case_id: (r.is_test, r.fold) for r in out.collect()}
        want = {}
        for label in (0, 1):
            own = sorted((c for c, b, _ in rows if b == bool(label)), key=lambda c: (hashlib.md5(f"{c}#{ml.ML_SEED}".encode()).hexdigest(), c))
            n = math.ceil(len(own) * ml.ML_TEST_FRACTION)
            want |= {c: (1, None) if i < n else (0, (i - n) % ml.ML_FOLDS) for i, c in enumerate(own)}
        assert got == want
    assert ml.split_and_folds(df.where("x < 0")).count() == 0


def test_split_needs_no_range_exchange_and_no_checkpoint(spark):
    import __spark_entry__ as E

    plan = E.queries()["ml_split"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan


def test_features_read_the_cases_once(spark):
    rows = [(f"c{i}", ["Won", None, "Lost"][i % 3], ["New", "Old", None][i % 3], i % 2) for i in range(30)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "case_id string, outcome string, application_type string, sla_breach int"
    cases = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    got = {r.case_id: r for r in ml.feature_table(cases).collect()}
    assert seen.value == len(rows)
    assert [got[f"c{i}"].outcome_encoded for i in range(3)] == [2.0, 1.0, 0.0]   # Lost, Other, Won
    assert [got[f"c{i}"].app_type_encoded for i in range(3)] == [0.0, 1.0, 2.0]  # New, Old, Unknown
    assert ml.feature_table(cases.limit(0)).collect() == []
