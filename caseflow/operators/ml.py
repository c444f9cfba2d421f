"""Explanatory SLA-breach models (ML-1..16) on ``pyspark.ml``.

The feature table, class weights, split and folds are DataFrame operators;
fitting uses Spark's distributed learners (trees are built by aggregating
split statistics across partitions, never by collecting the data).  Only
scalar metrics and per-feature importances -- a handful of numbers per
model -- reach the driver.

Note: the features include the outcome and final counts, known only when a
case ends, so these models explain breaches after the fact; they do not
forecast them.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from caseflow.model import (GB_DEPTH, GB_RATE, GB_ROUNDS, LR_MAX_ITER, ML_FOLDS, ML_SEED,
                            ML_TEST_FRACTION, RF_DEPTH, RF_MIN_LEAF, RF_TREES, WEEKDAY_NAMES)
from caseflow.operators.ranking import positions, running_sums
from caseflow.operators.util import materialised, share_of_all
from caseflow.schema import CASE

NUMERIC = ["n_events", "n_unique_activities", "n_resources", "has_rework", "rework_events",
           "start_month"]


def feature_table(cases: DataFrame) -> DataFrame:
    """ML-1..4: numeric coercion (NULL -> 0), log(1 + amount), alphabetical
    codes for outcome / application type, weekday code; label column."""
    cols = [CASE]
    feats = []
    for c in NUMERIC:
        if c in cases.columns:
            cols.append(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c))
            feats.append(c)
    if "requested_amount" in cases.columns:
        cols.append(F.log1p(F.coalesce(F.col("requested_amount").try_cast("double"), F.lit(0.0)))
                    .alias("log_requested_amount"))
        feats.append("log_requested_amount")
    if "outcome" in cases.columns:
        cols.append(F.coalesce(F.col("outcome"), F.lit("Other")).alias("_outcome"))
    if "start_dow" in cases.columns:
        day_code = F.create_map(*[x for i, d in enumerate(WEEKDAY_NAMES)
                                  for x in (F.lit(d), F.lit(float(i)))])
        cols.append(F.coalesce(F.try_element_at(day_code, F.col("start_dow")), F.lit(0.0))
                    .alias("dow_encoded"))
    if "application_type" in cases.columns:
        cols.append(F.coalesce(F.col("application_type"), F.lit("Unknown")).alias("_app_type"))
    cols.append(F.coalesce(F.col("sla_breach"), F.lit(0)).cast("int").alias("label"))
    df = cases.select(*cols)
    coded = {src: dst for src, dst in (("_outcome", "outcome_encoded"), ("_app_type", "app_type_encoded"))
             if src in df.columns}
    if coded:
        # written once: the codes are fitted on all cases before any is encoded
        df = _label_encode(materialised(df, "uncoded-features"), coded)
    feats += [c for c in ("outcome_encoded", "dow_encoded", "app_type_encoded") if c in df.columns]
    return df.select(CASE, *feats, "label")


def _label_encode(df: DataFrame, coded: dict[str, str]) -> DataFrame:
    """Alphabetical codes 0..k-1 of several columns, fitted in one pass (the
    vocabularies, not the data, reach the driver)."""
    idx = StringIndexer(inputCols=list(coded), outputCols=list(coded.values()), stringOrderType="alphabetAsc",
                        handleInvalid="keep").fit(df)
    return idx.transform(df).drop(*coded)


def feature_names(features: DataFrame) -> list:
    return [c for c in features.columns if c not in (CASE, "label", "weight", "is_test",
                                                     "fold", "_h")]


def class_balance(features: DataFrame) -> DataFrame:
    """ML-5: cases and share per label."""
    return share_of_all(features.groupBy("label").agg(F.count(F.lit(1)).alias("n_cases")),
                        "label", "n_cases")


def balanced_weights(features: DataFrame) -> DataFrame:
    """ML-10: weight = n / (2 * n_label) per label (2-row table)."""
    per = features.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    total = F.sum("n_label").over(Window.partitionBy(F.lit(0)))  # over 2 rows
    return per.select("label", "n_label", (total / (2.0 * F.col("n_label"))).alias("weight"))


RADIX = 4  # hex digits: 65,536 buckets a label


def split_and_folds(features: DataFrame, test_fraction: float = ML_TEST_FRACTION,
                    folds: int = ML_FOLDS, seed: int = ML_SEED) -> DataFrame:
    """ML-6 / ML-11: deterministic stratified split and folds.

    Each case gets ``h`` = md5(case_id # seed) (hex text; the text order is
    the number order).  Inside each label the first ceil(fraction * n) cases
    by (h, case_id) are the test part; the training cases are dealt round
    the folds in the same order.

    The position of a case is a radix rank: cases are counted by label and the
    first ``RADIX`` hex digits of h, running sums of these counts (at most
    16 ** RADIX rows a label, broadcast) give every bucket its offset, and a case
    is ranked inside its bucket only.  A hash spreads any cases evenly, so
    nothing is sampled, range-partitioned or checkpointed, and no label is ever
    gathered in one task."""
    h = F.md5(F.concat(F.col(CASE).cast("string"), F.lit(f"#{seed}")))
    rows = features.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, RADIX), 16, 10).cast("int"))
    label = Window.partitionBy("label")
    buckets = rows.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = buckets.select(
        F.col("label").alias("_l"), F.col("_b").alias("_ob"), F.sum("_c").over(label).alias("_n"),
        F.coalesce(F.sum("_c").over(label.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_before"))
    inside = F.row_number().over(Window.partitionBy("label", "_b").orderBy("_h", CASE))
    ranked = rows.withColumn("_i", inside).join(
        F.broadcast(offsets), F.col("label").eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_ob")))
    p = F.col("_before") + F.col("_i")
    n_test = F.ceil(F.col("_n") * F.lit(float(test_fraction)))
    is_test = (p <= n_test).cast("int")
    fold = F.when(is_test == 0, F.pmod(p - n_test - 1, F.lit(folds))).cast("int")
    return ranked.select(*features.columns, is_test.alias("is_test"), fold.alias("fold"))


def _assembler(feats):
    return VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")


def model_specs(feats: list, n_train: int, rf_trees: int = RF_TREES,
                gb_rounds: int = GB_ROUNDS) -> dict:
    """ML-7..9 as unfitted pipelines, reference hyper-parameters."""
    rf = RandomForestClassifier(numTrees=rf_trees, maxDepth=RF_DEPTH,
                                minInstancesPerNode=RF_MIN_LEAF, weightCol="weight",
                                seed=ML_SEED, labelCol="label")
    gb = GBTClassifier(maxIter=gb_rounds, maxDepth=GB_DEPTH, stepSize=GB_RATE, seed=ML_SEED,
                       labelCol="label")
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    # C = 1 of the original (sum of losses + 0.5 |b|^2) in Spark's mean-loss
    # scale: regParam = 1 / sum(weights) = 1 / n_train for balanced weights.
    lr = LogisticRegression(featuresCol="scaled", maxIter=LR_MAX_ITER, weightCol="weight",
                            regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                            standardization=False, labelCol="label")
    return {
        "Random Forest": Pipeline(stages=[_assembler(feats), rf]),
        "Gradient Boosting": Pipeline(stages=[_assembler(feats), gb]),
        "Logistic Regression": Pipeline(stages=[_assembler(feats), scaler, lr]),
    }


@dataclass
class FitResult:
    models: dict = field(default_factory=dict)      # name -> PipelineModel
    metrics: list = field(default_factory=list)     # dict rows
    feats: list = field(default_factory=list)
    test: DataFrame | None = None
    best: str | None = None


# Training rows worth a task of their own: a round of boosting is a job per
# level, and with fewer rows starting tasks costs more than they do.
ROWS_A_TASK = 20_000


def _check_folds(train: DataFrame) -> int:
    """Number of training rows; every fold must leave rows to train on and to
    measure with."""
    n = {r["fold"]: r["count"] for r in train.groupBy("fold").count().collect()}
    if set(n) != set(range(ML_FOLDS)):
        raise ValueError(f"training rows in folds {sorted(n, key=str)}, want 0 to {ML_FOLDS - 1}")
    return sum(n.values())


def fit_models(prepared: DataFrame, select_by: str = "test_auc", parallelism: int = 3 * (ML_FOLDS + 1),
               rf_trees: int = RF_TREES, gb_rounds: int = GB_ROUNDS) -> FitResult:
    """ML-11..13: 5-fold CV AUC (mean, std) on the training part, fit on the
    whole training part, test AUC and accuracy; best model by ``select_by``
    (test AUC as in the original; 'cv_auc' is the sounder choice).  The fits do
    not depend on one another: ``parallelism`` of them run side by side."""
    feats = feature_names(prepared)
    spark = prepared.sparkSession
    train, test = (prepared.filter(F.col("is_test") == k) for k in (0, 1))
    n_train = _check_folds(train)
    # all cores share the training rows, if there are enough of them.  They are
    # written and not cached: no fit then waits for the executor that holds them
    parts = max(1, min(spark.sparkContext.defaultParallelism, n_train // ROWS_A_TASK))
    train = materialised(train.repartition(parts), "train")
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC")
    res = FitResult(feats=feats, test=test)
    # a fold trains on (k - 1) / k of the rows, and its penalty scales so
    in_folds = model_specs(feats, n_train * (ML_FOLDS - 1) // ML_FOLDS, rf_trees, gb_rounds)
    whole = model_specs(feats, n_train, rf_trees, gb_rounds)

    def fit(name, fold):
        if fold is not None:
            model = in_folds[name].fit(train.filter(F.col("fold") != fold))
            return ev.evaluate(model.transform(train.filter(F.col("fold") == fold)))
        model = whole[name].fit(train)
        pred = model.transform(test)
        acc = pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        return model, ev.evaluate(pred), acc

    # boosting runs many short jobs one after the other, so it begins first and
    # the others use the cores that it leaves
    tasks = [(name, fold) for name in sorted(whole, key=lambda m: m != "Gradient Boosting")
             for fold in (None, *range(ML_FOLDS))]
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        # one wrapped function a task: each holds its own copy of the local properties
        done = dict(zip(tasks, pool.map(lambda call: call(), [
            inheritable_thread_target(spark)(partial(fit, *t)) for t in tasks])))
    for name in whole:
        aucs = [done[name, i] for i in range(ML_FOLDS)]
        res.models[name], test_auc, acc = done[name, None]
        res.metrics.append({"model": name, "cv_auc": float(np.mean(aucs)), "cv_std": float(np.std(aucs)),
                            "test_auc": float(test_auc), "test_acc": float(acc or 0.0)})
    key = "cv_auc" if select_by == "cv_auc" else "test_auc"
    res.best = max(res.metrics, key=lambda m: m[key])["model"]
    for m in res.metrics:
        m["is_best"] = int(m["model"] == res.best)
    return res


# ---- stored models -----------------------------------------------------------------

def table_digest(df: DataFrame) -> str:
    """Number and hashes of the rows of a table, whatever their order: equal for
    equal tables, so that a changed input is another key."""
    cols = sorted(df.columns)
    h = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]))
    row = df.agg(F.count(F.lit(1)), h(0), h(1)).first()
    text = f"{tuple(row)}" + ",".join(f"{c}:{t}" for c, t in sorted(df.dtypes))
    return hashlib.md5(text.encode()).hexdigest()


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fit_or_load(prepared: DataFrame, store: str, select_by: str = "test_auc", **params) -> FitResult:
    """:func:`fit_models`, once for each table and set of parameters: fitted
    pipelines are saved by Spark's ML writer below ``store``, in a folder named
    by the digest of ``prepared`` and the parameters, with their measures as
    Parquet, written last.  Later calls, also of other applications, read them."""
    spark = prepared.sparkSession
    settings = {"select_by": select_by, "seed": ML_SEED, "folds": ML_FOLDS, **params}
    key = hashlib.md5((table_digest(prepared) + json.dumps(settings, sort_keys=True)).encode()).hexdigest()
    path = f"{store.rstrip('/')}/{key}"
    if not _exists(spark, f"{path}/measures/_SUCCESS"):
        res = fit_models(prepared, select_by, **params)
        for name, model in res.models.items():
            model.write().overwrite().save(f"{path}/{name.replace(' ', '-')}")
        comparison(spark, res).coalesce(1).write.mode("overwrite").parquet(f"{path}/measures")
        return res
    metrics = [r.asDict() for r in spark.read.parquet(f"{path}/measures").collect()]
    models = {m["model"]: PipelineModel.load(f"{path}/{m['model'].replace(' ', '-')}") for m in metrics}
    return FitResult(models, metrics, feature_names(prepared), prepared.filter(F.col("is_test") == 1),
                     next(m["model"] for m in metrics if m["is_best"]))


def comparison(spark, res: FitResult) -> DataFrame:
    """ML-13: model x metric table (3 rows of scalars)."""
    return spark.createDataFrame(
        res.metrics, "model string, cv_auc double, cv_std double, test_auc double, "
                     "test_acc double, is_best int")


def importances(spark, res: FitResult) -> DataFrame:
    """ML-14: per model and feature; tree importances, |coefficient| for the
    logistic model (on standardised features)."""
    rows = []
    for name, pm in res.models.items():
        last = pm.stages[-1]
        if hasattr(last, "featureImportances"):
            vals = last.featureImportances.toArray().tolist()
        else:
            vals = [abs(v) for v in last.coefficients.toArray().tolist()]
        rows += [{"model": name, "feature": f, "importance": float(v)}
                 for f, v in zip(res.feats, vals)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def scored(res: FitResult, name: str) -> DataFrame:
    """Test rows with ``score`` = P(breach) and ``prediction``."""
    pred = res.models[name].transform(res.test)
    return pred.select(CASE, "label", "prediction",
                       vector_to_array("probability")[1].alias("score"))


def roc_points(scores: DataFrame) -> DataFrame:
    """ML-15: one ROC point per distinct score (descending threshold), plus
    the (0, 0) start.  Scores are grouped first (map-side), then running
    sums run distributed (no single-partition window)."""
    g = scores.groupBy("score").agg(
        F.sum(F.col("label").cast("long")).alias("tp"),
        F.sum((1 - F.col("label")).cast("long")).alias("fp"))
    tot = g.agg(F.sum("tp").alias("_P"), F.sum("fp").alias("_N"))
    cum = running_sums(g, [F.desc("score")], ["tp", "fp"])
    pts = (cum.crossJoin(F.broadcast(tot))
           .select(F.col("score").alias("threshold"),
                   (F.col("cum_fp") / F.col("_N")).alias("fpr"),
                   (F.col("cum_tp") / F.col("_P")).alias("tpr")))
    start = tot.select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                       F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def auc_from_roc(points: DataFrame) -> DataFrame:
    """Trapezoid AUC over ROC points (1 row).  Each point needs its
    predecessor in (fpr, tpr) order: a distributed position join."""
    p = positions(points.select("fpr", "tpr"), ["fpr", "tpr"], name="_i")
    prev = p.select((F.col("_i") + 1).alias("_i"), F.col("fpr").alias("_pf"),
                    F.col("tpr").alias("_pt"))
    seg = p.join(prev, "_i", "inner")
    return seg.agg(F.sum((F.col("fpr") - F.col("_pf")) * (F.col("tpr") + F.col("_pt")) / 2)
                   .alias("auc"))


def roc_points_by_model(res: FitResult) -> DataFrame:
    """ML-15 for every fitted model, with its name in ``model``."""
    out = None
    for name in res.models:
        pts = roc_points(scored(res, name)).select(F.lit(name).alias("model"), "threshold", "fpr", "tpr")
        out = pts if out is None else out.unionByName(pts)
    return out


def confusion(scores: DataFrame) -> DataFrame:
    """ML-16: counts for the four (label, prediction) cells, zero-filled."""
    spark = scores.sparkSession
    cells = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)],
                                  "label int, prediction int")
    got = (scores.select(F.col("label").cast("int").alias("label"),
                         F.col("prediction").cast("int").alias("prediction"))
           .groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n_cases")))
    return (F.broadcast(cells).join(got, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("n_cases", F.lit(0)).cast("long")
                    .alias("n_cases")))


def prepare(cases: DataFrame) -> DataFrame:
    """Features + balanced weight + split/folds, ready for :func:`fit_models`."""
    split = split_and_folds(feature_table(cases))
    # weights come from the training part alone
    w = balanced_weights(split.filter(F.col("is_test") == 0)).select("label", "weight")
    return (split.join(F.broadcast(w), "label", "left")  # 2 rows
            .fillna(1.0, subset=["weight"]))


__all__ = ["feature_table", "class_balance", "balanced_weights", "split_and_folds",
           "model_specs", "fit_models", "fit_or_load", "table_digest", "comparison", "importances", "scored", "roc_points",
           "auc_from_roc", "confusion", "prepare"]
