"""Rework: activities repeated inside a case (RWK-1..4, FLT-2, JN-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.schema import ACTIVITY, CASE


def activity_counts(log: DataFrame) -> DataFrame:
    """RWK-1: events per (case, activity); map-side combined."""
    return log.groupBy(CASE, ACTIVITY).agg(F.count(F.lit(1)).alias("count"))


def repeated(counts: DataFrame) -> DataFrame:
    """FLT-2: (case, activity) pairs seen more than once."""
    return counts.filter(F.col("count") > 1)


def rework_prevalence(counts: DataFrame) -> DataFrame:
    """RWK-2 (1 row): cases with rework, all cases, share, extra events."""
    per_case = counts.groupBy(CASE).agg(F.max("count").alias("_mx"),
                                        F.sum(F.col("count") - 1).alias("_extra"))
    return per_case.agg(
        F.sum((F.col("_mx") > 1).cast("long")).alias("cases_with_rework"),
        F.count(F.lit(1)).alias("total_cases"),
        (F.avg((F.col("_mx") > 1).cast("double")) * 100).alias("rework_pct"),
        F.sum("_extra").cast("long").alias("rework_events"))


def rework_by_activity(counts: DataFrame, k: int | None = 10) -> DataFrame:
    """RWK-3: per activity, cases that repeat it and their mean repeat count;
    top ``k`` by cases (ties by activity name).  (case, activity) is unique
    in ``counts``, so a plain count is the distinct case count."""
    agg = (repeated(counts).groupBy(ACTIVITY)
           .agg(F.count(F.lit(1)).alias("cases_with_rework"),
                F.avg("count").alias("avg_repeats")))
    if k is None:
        return agg
    top = agg.orderBy(F.desc("cases_with_rework"), F.asc(ACTIVITY)).limit(k)
    w = Window.orderBy(F.desc("cases_with_rework"), F.asc(ACTIVITY))  # over k rows
    return top.withColumn("rework_rank", F.row_number().over(w).cast("long"))


def case_rework_flags(counts: DataFrame) -> DataFrame:
    """RWK-4: ``has_rework`` (max count > 1), ``rework_events`` (sum of
    count - 1) per case.  The case table derives the same two numbers from
    its own aggregation (events - distinct activities) without this pass."""
    return counts.groupBy(CASE).agg(
        (F.max("count") > 1).cast("int").alias("has_rework"),
        F.sum(F.col("count") - 1).cast("long").alias("rework_events"))


def attach_rework(cases: DataFrame, flags: DataFrame) -> DataFrame:
    """JN-4: left join on the case key, missing -> 0.  Both sides are
    aggregated by case_id, so the join reuses their hash partitioning."""
    base = cases.drop("has_rework", "rework_events")
    return (base.join(flags, CASE, "left")
            .fillna(0, subset=["has_rework", "rework_events"]))
