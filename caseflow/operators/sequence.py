"""Sequence operators: previous event, waiting time and position in a case.

A plain ``Window.partitionBy(case)`` puts a whole case in one task; a case
holding a large share of the log would then sort in one task.  Instead we
work in two levels keyed by ``(case_id, ts_slice)``:

1. inside each (case, slice): ``lag`` / ``row_number`` over (ts, seq, activity);
2. per (case, slice) one summary row (event count, last event); a window over
   the summary (one row per non-empty slice, far smaller than the log) gives
   the previous slice's last event and the number of earlier events;
3. the summary is joined back on (case, slice).  The log side is already
   hash-partitioned on (case, slice) by step 1, so only the summary moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.time import ts_slice
from caseflow.schema import ACTIVITY, CASE, SEQ, SLICE, TS


def order_columns():
    """Total order inside a case.  (ts, seq) is total when positions exist;
    activity breaks the remaining ties, which cleaning made unique."""
    return [F.col(TS), F.col(SEQ), F.col(ACTIVITY)]


def with_slice(log: DataFrame, slice_hours: int = 24) -> DataFrame:
    if SLICE in log.columns:
        return log
    return log.withColumn(SLICE, ts_slice(TS, slice_hours))


def with_previous(log: DataFrame, slice_hours: int = 24) -> DataFrame:
    """Add ``prev_ts``, ``prev_activity`` (NULL for the first event of a case)
    and ``position`` (0-based index in the case)."""
    log = with_slice(log, slice_hours)
    w_local = Window.partitionBy(CASE, SLICE).orderBy(*order_columns())
    local = (log
             .withColumn("_lprev_ts", F.lag(TS).over(w_local))
             .withColumn("_lprev_act", F.lag(ACTIVITY).over(w_local))
             .withColumn("_lidx", F.row_number().over(w_local) - 1))

    summary = log.groupBy(CASE, SLICE).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.struct(F.col(TS).alias("ts"), F.col(SEQ).alias("seq"),
                       F.col(ACTIVITY).alias("activity"))).alias("_last"))
    w_case = Window.partitionBy(CASE).orderBy(SLICE)
    summary = summary.select(
        CASE, SLICE,
        F.lag("_last").over(w_case).alias("_prior"),
        F.coalesce(F.sum("_n").over(w_case.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"))

    joined = local.join(summary, [CASE, SLICE], "inner")
    first_in_slice = F.col("_lidx") == 0
    return (joined
            .withColumn("prev_ts", F.when(first_in_slice, F.col("_prior.ts"))
                        .otherwise(F.col("_lprev_ts")))
            .withColumn("prev_activity", F.when(first_in_slice, F.col("_prior.activity"))
                        .otherwise(F.col("_lprev_act")))
            .withColumn("position", (F.col("_offset") + F.col("_lidx")).cast("long"))
            .drop("_lprev_ts", "_lprev_act", "_lidx", "_prior", "_offset"))
