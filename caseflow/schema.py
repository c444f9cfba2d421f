"""Canonical event-log schema and column names."""

from __future__ import annotations

from pyspark.sql import types as T

CASE = "case_id"
ACTIVITY = "activity"
TS = "ts"
SEQ = "event_seq"
RESOURCE = "resource"
LIFECYCLE = "lifecycle"
LOAN_GOAL = "loan_goal"
AMOUNT = "requested_amount"
APP_TYPE = "application_type"
SLICE = "ts_slice"

CRITICAL = [CASE, ACTIVITY, TS]
BUSINESS = [LOAN_GOAL, AMOUNT, APP_TYPE]

EVENT_LOG = T.StructType([
    T.StructField(CASE, T.StringType(), False),
    T.StructField(ACTIVITY, T.StringType(), False),
    T.StructField(TS, T.TimestampNTZType(), False),
    T.StructField(RESOURCE, T.StringType(), True),
    T.StructField(LIFECYCLE, T.StringType(), True),
    T.StructField(LOAN_GOAL, T.StringType(), True),
    T.StructField(AMOUNT, T.DoubleType(), True),
    T.StructField(APP_TYPE, T.StringType(), True),
    T.StructField(SEQ, T.LongType(), True),
])

# Source attribute names of the XES standard extensions -> canonical names.
XES_NAMES = {
    "case:concept:name": CASE,
    "concept:name": ACTIVITY,
    "time:timestamp": TS,
    "org:resource": RESOURCE,
    "lifecycle:transition": LIFECYCLE,
    "case:LoanGoal": LOAN_GOAL,
    "case:RequestedAmount": AMOUNT,
    "case:ApplicationType": APP_TYPE,
}


def conform(df):
    """Add any missing optional column as typed NULL and order the columns."""
    from pyspark.sql import functions as F

    cols = []
    for f in EVENT_LOG.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in EVENT_LOG.fieldNames()]
    return df.select(*cols, *extra)
