"""Headline and dashboard tables (KPI-1..5, SNK-4 re-aimed as DataFrames).

KPI-1/KPI-2 are single rows assembled from 1-row aggregates with broadcast
cross joins.  KPI-3..5 are grouped tables whose size is bounded by months,
outcomes and distinct-activity counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators.cases import duration_profile
from caseflow.operators.ranking import quantiles
from caseflow.operators.variants import variant_coverage
from caseflow.schema import ACTIVITY, TS


def discovery_summary(log: DataFrame, cases: DataFrame, counts: DataFrame,
                      exact: bool = True) -> DataFrame:
    """KPI-1: events, cases, activities, dates, variants, top-3 share,
    duration profile, breaches."""
    per = log.groupBy(ACTIVITY).agg(F.count(F.lit(1)).alias("n"), F.min(TS).alias("lo"),
                                    F.max(TS).alias("hi"))
    ev = per.agg(F.sum("n").alias("n_events"), F.count(ACTIVITY).alias("n_activities"),
                 F.date_format(F.min("lo"), "yyyy-MM-dd").alias("first_date"),
                 F.date_format(F.max("hi"), "yyyy-MM-dd").alias("last_date"))
    cov = variant_coverage(counts).select("n_variants", "top3_share_pct", "tail_share_pct")
    prof = duration_profile(cases, exact)
    return (F.broadcast(ev).crossJoin(F.broadcast(cov)).crossJoin(F.broadcast(prof))
            .select("n_events", "n_cases", "n_activities", "first_date", "last_date",
                    "n_variants", "top3_share_pct", "tail_share_pct", "mean_days",
                    "median_days", "min_days", "max_days", "sla_breaches", "breach_pct",
                    "met_pct"))


def bottleneck_summary(stats: DataFrame, rework_prev: DataFrame, conf_rate: DataFrame,
                       ml: DataFrame | None = None) -> DataFrame:
    """KPI-2: top bottleneck with its mean wait and total days, rework and
    conformance rates; the best model's metrics when ``ml`` is given."""
    top = (stats.orderBy(F.desc("bottleneck_score"), F.asc(ACTIVITY)).limit(1)
           .select(F.col(ACTIVITY).alias("top_bottleneck"),
                   F.col("mean_wait_hours").alias("top_mean_wait_hours"),
                   F.col("total_wait_days").alias("top_total_wait_days")))
    rw = rework_prev.select("rework_pct", "rework_events")
    cf = conf_rate.select("conformance_rate_pct",
                          (100 - F.col("conformance_rate_pct")).alias("non_conformance_pct"))
    out = F.broadcast(top).crossJoin(F.broadcast(rw)).crossJoin(F.broadcast(cf))
    if ml is not None:
        out = out.crossJoin(F.broadcast(ml))
    return out


def monthly_trend(cases: DataFrame) -> DataFrame:
    """KPI-3: cases, breach rate, mean duration per start month."""
    return (cases.groupBy(F.date_format(F.date_trunc("month", "case_start"), "yyyy-MM")
                          .alias("start_period"))
            .agg(F.count(F.lit(1)).alias("n_cases"),
                 (F.avg("sla_breach") * 100).alias("breach_rate_pct"),
                 F.avg("duration_days").alias("mean_days")))


def outcome_sla_matrix(cases: DataFrame) -> DataFrame:
    """KPI-4: outcome x SLA cross table (pivot on known values: no extra pass)."""
    return (cases.groupBy("outcome").pivot("sla_breach", [0, 1])
            .agg(F.count(F.lit(1)))
            .select("outcome", F.coalesce(F.col("0"), F.lit(0)).cast("long").alias("sla_met"),
                    F.coalesce(F.col("1"), F.lit(0)).cast("long").alias("sla_breached")))


def complexity_vs_duration(cases: DataFrame, exact: bool = True) -> DataFrame:
    """KPI-5: per distinct-activity count: cases, mean and median days."""
    return quantiles(cases, "duration_days", {"median_days": 0.5}, ["n_unique_activities"], exact,
                     extra={"n_cases": F.count, "mean_days": F.avg}).select(
        "n_unique_activities", "n_cases", "mean_days", "median_days")
