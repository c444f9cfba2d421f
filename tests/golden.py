"""The hand-worked golden log (reference process model, 14-day SLA)."""

from __future__ import annotations

from pyspark.sql import functions as F

# case, ts, activity, resource, seq
EVENTS = [
    ("A", "2024-01-01 09:00:00", "A_Create Application", "u1", 1),
    ("A", "2024-01-01 12:00:00", "O_Create Offer", "u2", 2),
    ("A", "2024-01-02 12:00:00", "A_Complete", "u1", 3),
    ("B", "2024-01-01 00:00:00", "A_Submitted", "u1", 4),
    ("B", "2024-01-11 00:00:00", "W_Call after offers", None, 5),
    ("B", "2024-01-21 00:00:00", "W_Call after offers", None, 6),
    ("C", "2024-02-01 00:00:00", "O_Sent (online only)", "u3", 7),
    ("C", "2024-02-01 01:00:00", "A_Cancelled", "u3", 8),
    ("D", "2024-01-01 00:00:00", "A_Create Application", "u1", 9),
    ("D", "2024-03-10 00:00:00", "O_Cancelled", "u2", 10),
]

# rows cleaning must remove (or collapse): a later copy of A's second event,
# a NULL activity, an unparsable time
DIRTY = [
    ("A", "2024-01-01 12:00:00", "O_Create Offer", "u9", 11),
    ("A", "2024-01-01 13:00:00", None, "u1", 12),
    ("B", "not a date", "A_Submitted", "u1", 13),
]

SCHEMA = "case_id string, ts string, activity string, resource string, event_seq long"


def golden_raw(spark, dirty: bool = True):
    rows = EVENTS + (DIRTY if dirty else [])
    return spark.createDataFrame(rows, SCHEMA)


def golden_log(spark, dirty: bool = True):
    from caseflow.operators.clean import clean

    return clean(golden_raw(spark, dirty))


def by_case(df, key="case_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def approx(x, y, tol=1e-6):
    return x is not None and abs(x - y) <= tol


__all__ = ["EVENTS", "DIRTY", "golden_raw", "golden_log", "by_case", "approx", "F"]
