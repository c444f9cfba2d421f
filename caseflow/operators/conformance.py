"""Conformance against a simple process model (CNF-1..8, JN-5).

Every rule is a per-case aggregate taken from :func:`cases.case_aggregates`
(first/last activity by order, marker presence, first A-group and last
O-group event), so checking needs no per-case Python and no list of events.
The order rule "first A position < last O position" compares the events'
(ts, seq, activity) keys, which is the same as comparing positions because
that key is the total order of the case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.time import hours_between
from caseflow.model import DEVIATION_NAMES, NO_DEVIATION, REFERENCE_MODEL, ProcessModel
from caseflow.schema import CASE

FLAGS = ["is_conformant", "starts_correctly", "ends_correctly", "no_rework_conf",
         "correct_order"]


def conformance(aggs: DataFrame, model: ProcessModel = REFERENCE_MODEL,
                keep: tuple = ()) -> DataFrame:
    """CNF-1..5: five 0/1 flags, the deviation list and its joined text;
    ``keep`` names further columns to carry."""
    starts = F.coalesce(F.col("first_activity").isin(list(model.start_activities)), F.lit(False))
    ends = F.coalesce(F.col("last_activity").isin(list(model.end_activities)), F.lit(False))
    no_rework = ~F.coalesce(F.col("has_marker"), F.lit(False))
    order_ok = (F.col("first_a").isNull() | F.col("last_o").isNull()
                | (F.col("first_a") < F.col("last_o")))
    ok = starts & ends & no_rework & order_ok
    devs = F.array_compact(F.array(*[
        F.when(~cond, F.lit(name))
        for cond, name in zip([starts, ends, no_rework, order_ok], DEVIATION_NAMES)]))
    return aggs.select(
        CASE,
        ok.cast("int").alias("is_conformant"),
        starts.cast("int").alias("starts_correctly"),
        ends.cast("int").alias("ends_correctly"),
        no_rework.cast("int").alias("no_rework_conf"),
        order_ok.cast("int").alias("correct_order"),
        devs.alias("deviations"),
        *keep,
    ).withColumn("deviation_types",
                 F.when(F.size("deviations") == 0, F.lit(NO_DEVIATION))
                 .otherwise(F.array_join("deviations", ",")))


def conformance_rate(conf: DataFrame) -> DataFrame:
    """CNF-6 (1 row): conformance %, conforming and non-conforming cases."""
    return conf.agg(
        (F.avg("is_conformant") * 100).alias("conformance_rate_pct"),
        F.sum("is_conformant").cast("long").alias("conformant_cases"),
        F.sum(1 - F.col("is_conformant")).cast("long").alias("non_conformant_cases"),
        F.count(F.lit(1)).alias("n_cases"))


def deviation_breakdown(conf: DataFrame) -> DataFrame:
    """CNF-7: cases per deviation type (empty when every case conforms)."""
    return (conf.select(F.explode("deviations").alias("deviation"))
            .groupBy("deviation").agg(F.count(F.lit(1)).alias("n_cases")))


def attach_conformance(cases: DataFrame, conf: DataFrame) -> DataFrame:
    """JN-5: left join on case key; unmatched cases get 0 flags."""
    return (cases.join(conf.select(CASE, *FLAGS, "deviation_types"), CASE, "left")
            .fillna(0, subset=FLAGS))


def breach_by_conformance(cases: DataFrame, conf: DataFrame) -> DataFrame:
    """CNF-8 (1 row): breach % of conforming and of other cases, and their
    ratio (NULL unless the conforming rate is above 0)."""
    return _breach_rates(attach_conformance(cases.select(CASE, "sla_breach"), conf))


def breach_by_conformance_of(aggs: DataFrame, model: ProcessModel = REFERENCE_MODEL) -> DataFrame:
    """CNF-8 from the case aggregates: flags and breach are columns of one
    row, so nothing is joined."""
    days = hours_between("case_start", "case_end") / 24
    breach = (days > F.lit(model.sla_days)).cast("int")
    return _breach_rates(conformance(aggs.withColumn("sla_breach", breach), model, ("sla_breach",)))


def _breach_rates(m: DataFrame) -> DataFrame:
    r = m.agg(
        (F.avg(F.when(F.col("is_conformant") == 1, F.col("sla_breach"))) * 100)
        .alias("breach_pct_conformant"),
        (F.avg(F.when(F.col("is_conformant") == 0, F.col("sla_breach"))) * 100)
        .alias("breach_pct_non_conformant"))
    return r.withColumn(
        "breach_ratio",
        F.when(F.col("breach_pct_conformant") > 0,
               F.col("breach_pct_non_conformant") / F.col("breach_pct_conformant")))
