"""Cleaning: standardise names, drop incomplete rows, coerce time, dedup.

The survivor of a duplicate group is fixed (first by ``event_seq``, else
smallest remaining attributes), so the result never depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.text import squeeze_whitespace
from caseflow.functions.time import ts_slice
from caseflow.schema import (ACTIVITY, CASE, CRITICAL, LOAN_GOAL, SEQ, SLICE, TS,
                             XES_NAMES)


def standardise_case_column(df: DataFrame, target: str = "case:concept:name") -> DataFrame:
    """Rename the column whose lower-cased name holds 'case', 'concept' and
    'name' to ``target``.  Two such columns are ambiguous and raise."""
    hits = [c for c in df.columns
            if all(w in c.lower() for w in ("case", "concept", "name"))]
    if len(hits) > 1:
        raise ValueError(f"ambiguous case-id columns: {hits}")
    if hits and hits[0] != target:
        return df.withColumnsRenamed({hits[0]: target})
    return df


def rename_to_canonical(df: DataFrame, names: dict | None = None) -> DataFrame:
    """XES-style attribute names -> canonical column names."""
    names = XES_NAMES if names is None else names
    present = {k: v for k, v in names.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def drop_incomplete(df: DataFrame, critical=CRITICAL) -> DataFrame:
    existing = [c for c in critical if c in df.columns]
    return df.dropna(subset=existing) if existing else df


def coerce_timestamp(df: DataFrame, col: str = TS, fmt: str | None = None) -> DataFrame:
    """Parse ``col`` to TIMESTAMP_NTZ; unparsable values become NULL and drop."""
    dtype = dict(df.dtypes).get(col)
    if dtype == "timestamp_ntz":
        parsed = F.col(col)
    elif dtype in ("timestamp", "date"):
        parsed = F.col(col).cast("timestamp_ntz")
    else:
        s = F.col(col).cast("string")
        parsed = (F.try_to_timestamp(s, F.lit(fmt)) if fmt else F.try_to_timestamp(s))
        parsed = parsed.cast("timestamp_ntz")
    return df.withColumn(col, parsed).filter(F.col(col).isNotNull())


def dedup_events(df: DataFrame, key=(CASE, ACTIVITY, TS)) -> DataFrame:
    """Exact-duplicate removal on ``key``, keeping the first event.

    The survivor is the row with the smallest ``event_seq`` (then the
    smallest remaining attributes, for NULL or equal positions), so the
    result never depends on partitioning.  A group of copies is reduced
    map-side, so a hot duplicate group never reaches one task whole.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.dropDuplicates(key)
    if rest == [SEQ]:
        # nothing but the position to keep: a plain hash aggregate
        return df.groupBy(*key).agg(F.min(SEQ).alias(SEQ)).select(*df.columns)
    payload = F.struct(*[F.col(c) for c in rest])
    if SEQ in df.columns:
        keep = F.min(F.struct(F.col(SEQ).alias("_o"), payload.alias("_p")))["_p"]
    else:
        keep = F.min(payload)
    out = df.groupBy(*key).agg(keep.alias("_keep"))
    return out.select(*key, *[F.col("_keep")[c].alias(c) for c in rest]).select(*df.columns)


def squeeze_loan_goal(df: DataFrame, col: str = LOAN_GOAL) -> DataFrame:
    if col not in df.columns:
        return df
    return df.withColumn(col, squeeze_whitespace(col))


def clean(df: DataFrame, keep: list | tuple | None = None, slice_hours: int = 24) -> DataFrame:
    """CLN-1..4 on a canonical or XES-named log.

    ``keep`` names the attribute columns to carry besides case, activity, ts
    and event_seq (default: all).  The survivor of a duplicate group is
    chosen over every kept column, so Catalyst cannot prune what is kept:
    pass only what the analysis needs and the scan/shuffle shrink with it.

    The log always carries ``ts_slice`` (the slice is a function of ts, so
    adding it to the dedup key changes nothing).  A log that feeds several
    sequence operators is best written bucketed by case and slice
    (``util.bucketed``), as the end-to-end jobs do.
    """
    df = rename_to_canonical(standardise_case_column(df))
    if keep is not None:
        core = [c for c in (CASE, ACTIVITY, TS, SEQ) if c in df.columns]
        df = df.select(*core, *[c for c in keep if c in df.columns and c not in core])
    df = drop_incomplete(df)
    df = coerce_timestamp(df)
    df = df.withColumn(SLICE, ts_slice(TS, slice_hours))
    # Spark plans the dedup with a partial (map-side) aggregation, so a group
    # of copies holding a large share of the rows is collapsed before any
    # shuffle
    return dedup_events(df, key=(CASE, SLICE, ACTIVITY, TS))


def clean_profile(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: original, removed, clean events, cases, activities, first/last date.

    Distinct values are counted as groups; the aggregates are single rows
    joined with each other.
    """
    before = raw.agg(F.count(F.lit(1)).alias("original_events"))
    per_case = cleaned.groupBy(CASE).agg(F.count(F.lit(1)).alias("n"), F.min(TS).alias("lo"),
                                         F.max(TS).alias("hi"))
    after = per_case.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("clean_events"),
        F.count(F.lit(1)).alias("unique_cases"),
        F.to_date(F.min("lo")).alias("first_date"),
        F.to_date(F.max("hi")).alias("last_date"),
    )
    names = cleaned.groupBy(ACTIVITY).agg(F.lit(1).alias("n")).agg(
        F.count(F.lit(1)).alias("unique_activities"))
    return (F.broadcast(before).crossJoin(F.broadcast(after)).crossJoin(F.broadcast(names))
            .withColumn("removed_events", F.col("original_events") - F.col("clean_events"))
            .select("original_events", "removed_events", "clean_events", "unique_cases",
                    "unique_activities", "first_date", "last_date"))
