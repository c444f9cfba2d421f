"""Sketches that are stored per day and merged (BTN-1, CHT-5/6, FEA-7, AGG-4/5).

A quantile sketch of a group and day is a few kilobytes, whatever the number of
values; sketches of days merge into the sketch of any period without another
look at the events.  The rank of an answer is off by less than ``RANK_ERROR``,
twice what the sketch library publishes for its size (2.296 / K ** 0.9723 in 99
of 100 answers; sketches choose at random); :func:`rank_checked` measures it.
Distinct counts have the same two steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.schema import ACTIVITY, CASE, RESOURCE, TS

K = 400              # size of a quantile sketch
RANK_ERROR = 0.0136  # of a sketch of this size
LG_K = 12            # 4096 registers: relative error of a distinct count about 1.6 %


def quantile_sketches(df: DataFrame, value: str, group: list, k: int = K) -> DataFrame:
    """``group, sketch``: of all values of a group that are not null."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).groupBy(*group).agg(F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def daily_quantile_sketches(df: DataFrame, value: str, group: list, ts: str = TS, k: int = K) -> DataFrame:
    """``group, day, sketch``, to be stored (append a day's rows)."""
    return quantile_sketches(df.withColumn("day", F.to_date(ts)), value, [*group, "day"], k)


def merged_quantile_sketches(stored: DataFrame, group: list, k: int = K) -> DataFrame:
    """``group, sketch`` over all rows of ``stored`` (choose days before)."""
    return stored.groupBy(*group).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: dict) -> DataFrame:
    """One column for each of ``probs``, as ``ranking.quantiles`` (a value that
    occurs, no interpolation), and ``n``."""
    others = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*others, F.kll_sketch_get_n_double("sketch").alias("n"), *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()])


def rank_checked(df: DataFrame, value: str, group: list, answers: DataFrame, probs: dict,
                 error: float = RANK_ERROR) -> DataFrame:
    """``answers`` with, for each probability, whether the share of values below
    and up to the answer leaves it within ``error`` (``<name>_ok``)."""
    v = F.col(value).cast("double")
    # the answers are one row a group
    rows = df.where(v.isNotNull()).select(*group, v.alias("_v")).join(answers, group)
    shares = rows.groupBy(*group).agg(*[
        (F.sum((F.col("_v") < F.col(name)).cast("double")) / F.count(F.lit(1))).alias(f"_below_{name}")
        for name in probs], *[(F.sum((F.col("_v") <= F.col(name)).cast("double")) / F.count(F.lit(1))).alias(f"_upto_{name}")
                              for name in probs])
    ok = lambda name, p: ((F.col(f"_below_{name}") <= p + error) & (F.col(f"_upto_{name}") >= p - error)).alias(f"{name}_ok")
    return answers.join(shares, group).select(*answers.columns, *[ok(name, float(p)) for name, p in probs.items()])


# ---- distinct counts -------------------------------------------------------------

def daily_distinct_sketches(log: DataFrame, by: str = CASE, lg_k: int = LG_K) -> DataFrame:
    """``by, day, activities, resources``: sketches of the values of a day."""
    resource = F.hll_sketch_agg(RESOURCE, F.lit(lg_k)) if RESOURCE in log.columns else F.lit(None).cast("binary")
    return log.groupBy(by, F.to_date(TS).alias("day")).agg(
        F.hll_sketch_agg(ACTIVITY, F.lit(lg_k)).alias("activities"), resource.alias("resources"))


def distinct_counts(stored: DataFrame, group: list | tuple = ()) -> DataFrame:
    """``n_unique_activities`` and ``n_resources`` of each group, or of all."""
    one = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0))
    return stored.groupBy(*group).agg(one("activities").cast("long").alias("n_unique_activities"),
                                      one("resources").cast("long").alias("n_resources"))


def within(estimate: Column | str, exact: Column | str, error: float) -> Column:
    e, x = (F.col(c) if isinstance(c, str) else c for c in (estimate, exact))
    return F.abs(e - x) <= F.greatest(F.lit(0.5), F.lit(error) * x)
