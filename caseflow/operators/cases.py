"""Case-level aggregation and features (AGG-1..7, FEA-1..8, RWK-4, FLT-3).

All per-case facts -- times, counts, resources, first/last activity, first
non-NULL business attributes, conformance facts -- come from ONE
``groupBy(case_id)`` whose aggregates (min/max/count/min_by/max_by/bool_or)
all combine map-side, so a hot case reaches the final stage as one partial
row per map task.  Distinct counts are the sizes of value sets: a case has at
most as many activities as the process, and as many resources as the company,
so the sets are small, and no row is expanded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.classify import duration_bucket, in_group, outcome_of
from caseflow.functions.text import squeeze_whitespace
from caseflow.functions.time import (format_ts, hours_between, month_short_name,
                                     weekday_name)
from caseflow.model import REFERENCE_MODEL, ProcessModel
from caseflow.operators.util import share_of_all
from caseflow.schema import (ACTIVITY, AMOUNT, APP_TYPE, CASE, LOAN_GOAL, RESOURCE, SEQ,
                             TS)


def _order():
    return F.struct(F.col(TS).alias("ts"), F.col(SEQ).alias("seq"),
                    F.col(ACTIVITY).alias("activity"))


def _first_non_null(col: str):
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), _order()))


def _distinct(col: str, approx: bool):
    return F.approx_count_distinct(col) if approx else F.size(F.collect_set(col))


def case_aggregates(log: DataFrame, model: ProcessModel = REFERENCE_MODEL,
                    approx_resources: bool = False, approx_activities: bool = False) -> DataFrame:
    """One row per case with every raw per-case fact (one shuffle).
    ``approx_resources`` and ``approx_activities`` count by a sketch (AGG-4/5);
    ``operators.sketches`` has the same as stored states."""
    o = _order()
    is_a = in_group(F.col(ACTIVITY), model.a_prefix, model.a_activities)
    is_o = in_group(F.col(ACTIVITY), model.o_prefix, model.o_activities)
    has_res = RESOURCE in log.columns
    aggs = [
        F.min(TS).alias("case_start"),
        F.max(TS).alias("case_end"),
        F.count(ACTIVITY).alias("n_events"),
        _distinct(ACTIVITY, approx_activities).cast("long").alias("n_unique_activities"),
        (_distinct(RESOURCE, approx_resources) if has_res else F.lit(0)).cast("long").alias("n_resources"),
        F.max_by(ACTIVITY, o).alias("last_activity"),
        F.min_by(ACTIVITY, o).alias("first_activity"),
        F.bool_or(F.col(ACTIVITY).isin(list(model.rework_markers))).alias("has_marker"),
        F.min(F.when(is_a, o)).alias("first_a"),
        F.max(F.when(is_o, o)).alias("last_o"),
    ]
    for c in (LOAN_GOAL, AMOUNT, APP_TYPE):
        if c in log.columns:
            aggs.append(_first_non_null(c).alias(c))
    return log.groupBy(CASE).agg(*aggs)


def case_table(aggs: DataFrame, model: ProcessModel = REFERENCE_MODEL,
               format_times: bool = False) -> DataFrame:
    """The case table (one row per case) from :func:`case_aggregates`."""
    hours = hours_between("case_start", "case_end")
    days = F.col("duration_hours") / 24
    df = aggs.select(
        CASE, "case_start", "case_end",
        hours.alias("duration_hours"),
        "n_events", "n_unique_activities", "n_resources", "last_activity",
        *[F.col(c) for c in (LOAN_GOAL, AMOUNT, APP_TYPE) if c in aggs.columns])
    df = df.withColumn("duration_days", days)
    if LOAN_GOAL in df.columns:
        df = df.withColumn(LOAN_GOAL, squeeze_whitespace(LOAN_GOAL))
    df = (df
          .withColumn("outcome", outcome_of("last_activity", model))
          .withColumn("sla_breach", (F.col("duration_days") > F.lit(model.sla_days)).cast("int"))
          .withColumn("sla_days", F.lit(model.sla_days).cast("int"))
          .withColumn("start_month", F.month("case_start").cast("int"))
          .withColumn("start_quarter", F.quarter("case_start").cast("int"))
          .withColumn("start_dow", weekday_name("case_start"))
          .withColumn("start_month_name", month_short_name("case_start"))
          .withColumn("duration_bucket", duration_bucket("duration_days"))
          # rework flags: sum over activities of (count - 1) == events - distinct
          .withColumn("rework_events", (F.col("n_events") - F.col("n_unique_activities")).cast("long"))
          .withColumn("has_rework", (F.col("rework_events") > 0).cast("int")))
    cols = [CASE, "case_start", "case_end", "duration_hours", "duration_days", "n_events",
            "n_unique_activities", "n_resources", "last_activity",
            *[c for c in (LOAN_GOAL, AMOUNT, APP_TYPE) if c in df.columns],
            "outcome", "sla_breach", "sla_days", "start_month", "start_quarter", "start_dow",
            "start_month_name", "duration_bucket", "has_rework", "rework_events"]
    df = df.select(*cols)
    if format_times:
        df = (df.withColumn("case_start", format_ts("case_start"))
                .withColumn("case_end", format_ts("case_end")))
    if model.completed_only:
        df = completed_cases(df, model)
    return df


def build_case_table(log: DataFrame, model: ProcessModel = REFERENCE_MODEL) -> DataFrame:
    return case_table(case_aggregates(log, model), model)


def completed_cases(cases: DataFrame, model: ProcessModel = REFERENCE_MODEL) -> DataFrame:
    """FLT-3: drop cases still in process (the SLA view of the dashboards)."""
    return cases.filter(F.col("outcome") != F.lit(model.still_processing_label))


def duration_profile(cases: DataFrame, exact: bool = True) -> DataFrame:
    """FEA-7: cases, breaches, breach %, mean/median/min/max days (1 row)."""
    from caseflow.operators.ranking import scalar_quantile

    base = cases.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.sum("sla_breach").cast("long").alias("sla_breaches"),
        (F.avg("sla_breach") * 100).alias("breach_pct"),
        ((1 - F.avg("sla_breach")) * 100).alias("met_pct"),
        F.avg("duration_days").alias("mean_days"),
        F.min("duration_days").alias("min_days"),
        F.max("duration_days").alias("max_days"))
    med = scalar_quantile(cases, "duration_days", 0.5, exact).withColumnRenamed("q", "median_days")
    return F.broadcast(base).crossJoin(F.broadcast(med)).select(
        "n_cases", "sla_breaches", "breach_pct", "met_pct", "mean_days", "median_days",
        "min_days", "max_days")


def outcome_distribution(cases: DataFrame) -> DataFrame:
    """FEA-8: cases per outcome and share of all cases."""
    per = cases.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_cases"))
    return share_of_all(per, "outcome", "n_cases")
