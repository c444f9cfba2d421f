"""End-to-end jobs: discovery (clean -> cases -> variants -> chart data ->
summary) and bottleneck (waits -> rework -> models -> conformance -> summary).

Shared inputs are written once as Parquet below the cluster's
``spark.checkpoint.dir``: the branches that read them prune columns at the
scan, plans do not grow, and a lost executor only costs reading files again.
The clean log is bucketed by case and time slice, so its sequence operators
read it without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.model import REFERENCE_MODEL, ProcessModel
from caseflow.operators import cases as cs
from caseflow.operators import charts as ch
from caseflow.operators import clean as cl
from caseflow.operators import conformance as cf
from caseflow.operators import digests as dg
from caseflow.operators import kpi
from caseflow.operators import ml
from caseflow.operators import rework as rw
from caseflow.operators import variants as vr
from caseflow.operators import waits
from caseflow.operators.sequence import with_slice
from caseflow.operators.util import bucketed, materialised
from caseflow.schema import ACTIVITY, CASE
from caseflow.sources import sinks


def run_discovery(raw_log: DataFrame, model: ProcessModel = REFERENCE_MODEL,
                  keep: list | tuple | None = None) -> dict:
    """Everything the discovery step produces, as lazy DataFrames (the
    clean log, case table and variant counts are already materialised)."""
    log = bucketed(cl.clean(raw_log, keep, model.slice_hours), "clean-log")
    aggs = cs.case_aggregates(log, model)
    cases = cs.case_table(aggs, model)
    if model.completed_only:
        # one population for the log, the variants and the cases
        log = bucketed(log.join(cases.select(CASE), CASE, "left_semi"), "completed-log")
    digests = materialised(dg.case_digests(log, model.slice_hours), "digests")   # read twice
    counts = materialised(vr.variant_counts(digests), "variant-counts")
    ranks = materialised(vr.variant_texts(log, vr.variant_ranks(counts, log, model.slice_hours),
                                          model.slice_hours), "variant-ranks")
    cases_v = materialised(vr.attach_variants(cases, digests, ranks), "cases")
    exact = model.exact_quantiles
    return {
        "event_log_cleaned": log,
        "case_features": cases_v,
        "clean_profile": cl.clean_profile(raw_log, log),
        "variant_counts": ranks.select("variant", "n_cases", "variant_rank"),
        "activity_frequency": vr.activity_frequency(log),
        "variant_coverage": vr.variant_coverage(counts),
        "top_variants": vr.top_variants(counts, log, 5, model.slice_hours),
        "variant_pareto": vr.variant_pareto(counts, 20),
        "breach_by_rank_bucket": vr.breach_by_rank_bucket(cases_v),
        "duration_profile": cs.duration_profile(cases_v, exact),
        "outcome_distribution": cs.outcome_distribution(cases_v),
        "duration_histogram": ch.histogram(cases_v, "duration_days", 40, 60.0, exact=exact),
        "events_histogram": ch.histogram(cases_v, "n_events", 30, 50.0, exact=exact),
        "activities_histogram": ch.histogram(cases_v, "n_unique_activities", 20, 20.0, exact=exact),
        "breach_by_month": ch.breach_by_month(cases_v),
        "duration_box_by_outcome": ch.duration_box_by_outcome(cases_v, exact=exact),
        "breach_by_amount_quintile": ch.breach_by_amount_quintile(cases_v, exact=exact),
        "event_volume_by_month": ch.event_volume_by_month(log),
        "discovery_summary": kpi.discovery_summary(log, cases_v, counts, exact),
        "monthly_trend": kpi.monthly_trend(cases_v),
        "outcome_sla_matrix": kpi.outcome_sla_matrix(cases_v),
        "complexity_vs_duration": kpi.complexity_vs_duration(cases_v, exact),
    }


def run_bottleneck(log: DataFrame, cases: DataFrame, model: ProcessModel = REFERENCE_MODEL,
                   fit: bool = True, select_by: str = "test_auc") -> dict:
    """Everything the bottleneck step produces.  ``log`` is the clean log
    (``event_log_cleaned``), ``cases`` the case table."""
    # a clean log is not cleaned again; only its slice may have to be added
    log = with_slice(log, model.slice_hours)
    valid = materialised(waits.valid_transitions(waits.transitions(log, model), model)
                         .select(CASE, ACTIVITY, "prev_activity", "waiting_hours"), "waits")
    stats = materialised(waits.bottleneck_stats(valid, model), "wait-stats")   # feeds four outputs
    counts = rw.activity_counts(log)
    flags = rw.case_rework_flags(counts)
    aggs = cs.case_aggregates(log, model)
    conf = materialised(cf.conformance(aggs, model), "conformance")
    enriched = cf.attach_conformance(rw.attach_rework(cases, flags), conf)
    prevalence = rw.rework_prevalence(counts)
    rate = cf.conformance_rate(conf)
    out = {
        "bottleneck_summary": stats,
        "top_bottlenecks": waits.top_bottlenecks(stats, 10),
        "transition_waits": waits.transition_waits(valid),
        "wait_box_top5": waits.wait_box_top(valid, stats, 5, 0.95, model.exact_quantiles),
        "rework_prevalence": prevalence,
        "rework_by_activity": rw.rework_by_activity(counts, 10),
        "conformance": conf.drop("deviations"),
        "conformance_rate": rate,
        "deviation_breakdown": cf.deviation_breakdown(conf),
        "breach_by_conformance": cf.breach_by_conformance(cases, conf),
        "case_features_enriched": sinks.sanitize_for_export(enriched),
    }
    ml_row = None
    if fit:
        spark = log.sparkSession
        prepared = materialised(ml.prepare(cases), "prepared")
        res = ml.fit_models(prepared, select_by)
        comp = ml.comparison(spark, res)
        imps = ml.importances(spark, res)
        scored = ml.scored(res, res.best)
        out.update({
            "class_balance": ml.class_balance(prepared),
            "model_comparison": comp,
            "feature_importance": imps,
            "roc_points": ml.roc_points_by_model(res),
            "confusion_matrix": ml.confusion(scored),
        })
        best_imp = (imps.join(comp.filter("is_best = 1").select("model"), "model")
                    .orderBy(F.desc("importance"), F.asc("feature")).limit(1)
                    .select(F.col("feature").alias("top_feature"),
                            F.col("importance").alias("top_feature_importance")))
        ml_row = (comp.filter("is_best = 1")
                  .select(F.col("model").alias("best_model"), "cv_auc", "test_auc", "test_acc")
                  .crossJoin(best_imp))
    out["bottleneck_report"] = kpi.bottleneck_summary(stats, prevalence, rate, ml_row)
    return out


def write_outputs(tables: dict, out_dir: str, fmt: str = "parquet") -> dict:
    """SNK-1/2: one folder per table under ``out_dir``."""
    paths = {}
    for name, df in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        if fmt == "csv":
            df = sinks.sanitize_for_export(df) if name != "event_log_cleaned" else df
        if name == "event_log_cleaned":
            sinks.write_event_log(df, path, fmt)
        else:
            sinks.write_table(df, path, fmt)
        paths[name] = path
    return paths
