"""Case facts as states that merge (AGG-1..7, CNF-1..5, RWK-4).

A state row holds everything of :func:`cases.case_aggregates` in a form that
adds up: extremes, counts, value sets (as many values as the process has
activities or the company resources) and order keys with the value they carry.
States of disjoint sets of events merge into the state of their union, in any
order and grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.classify import in_group
from caseflow.model import REFERENCE_MODEL, ProcessModel
from caseflow.schema import ACTIVITY, AMOUNT, APP_TYPE, CASE, LOAN_GOAL, RESOURCE, SEQ, TS

ATTRIBUTES = (LOAN_GOAL, AMOUNT, APP_TYPE)


def _order() -> Column:
    return F.struct(F.col(TS).alias("ts"), F.col(SEQ).alias("seq"), F.col(ACTIVITY).alias("activity"))


def case_state(log: DataFrame, model: ProcessModel = REFERENCE_MODEL) -> DataFrame:
    """One state a case; the events must be clean (no copies)."""
    o = _order()
    is_a = in_group(F.col(ACTIVITY), model.a_prefix, model.a_activities)
    is_o = in_group(F.col(ACTIVITY), model.o_prefix, model.o_activities)
    resources = F.collect_set(RESOURCE) if RESOURCE in log.columns else F.array().cast("array<string>")
    return log.groupBy(CASE).agg(
        F.min(TS).alias("case_start"), F.max(TS).alias("case_end"), F.count(ACTIVITY).alias("n_events"),
        F.collect_set(ACTIVITY).alias("activities"), resources.alias("resources"),
        F.min(o).alias("first"), F.max(o).alias("last"),
        F.bool_or(F.col(ACTIVITY).isin(list(model.rework_markers))).alias("has_marker"),
        F.min(F.when(is_a, o)).alias("first_a"), F.max(F.when(is_o, o)).alias("last_o"),
        # the value of the first event that has one
        *[F.min(F.when(F.col(c).isNotNull(), F.struct(o.alias("o"), F.col(c).alias("v")))).alias(c)
          for c in ATTRIBUTES if c in log.columns])


def merge_states(states: DataFrame) -> DataFrame:
    """States with any number of rows a case -> one row a case."""
    both = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return states.groupBy(CASE).agg(
        F.min("case_start").alias("case_start"), F.max("case_end").alias("case_end"), F.sum("n_events").alias("n_events"),
        both("activities"), both("resources"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.bool_or("has_marker").alias("has_marker"), F.min("first_a").alias("first_a"), F.max("last_o").alias("last_o"),
        *[F.min(c).alias(c) for c in ATTRIBUTES if c in states.columns])


def finished(states: DataFrame) -> DataFrame:
    """The columns of :func:`cases.case_aggregates`."""
    return states.select(
        CASE, "case_start", "case_end", "n_events", F.size("activities").cast("long").alias("n_unique_activities"),
        F.size("resources").cast("long").alias("n_resources"), F.col("last.activity").alias("last_activity"),
        F.col("first.activity").alias("first_activity"), "has_marker", "first_a", "last_o",
        *[F.col(f"{c}.v").alias(c) for c in ATTRIBUTES if c in states.columns])
