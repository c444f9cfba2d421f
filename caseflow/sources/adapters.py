"""Adapters: view any table as an event log (canonical columns, schema.py).

Each adapter is a projection (plus a union for the order/line adapter); the
scan keeps column pruning and filter pushdown because nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.schema import conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_user_week(events: DataFrame) -> DataFrame:
    """``events`` as a log of user-weeks (the main adapter).

    case = user id + first day (Monday) of the event's week, which tells
    years apart; activity = event type; order = (ts, event_id); resource =
    the ``k`` property; amount = event value.
    """
    df = events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")).alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.get_json_object("props", "$.k").alias("resource"),
        F.col("value").cast("double").alias("requested_amount"),
        F.col("event_id").cast("long").alias("event_seq"),
    )
    return conform(df)


def events_user(events: DataFrame) -> DataFrame:
    """``events`` with one case per user (long cases, ~a month each)."""
    df = events.select(
        F.col("user_id").cast("string").alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.get_json_object("props", "$.k").alias("resource"),
        F.col("value").cast("double").alias("requested_amount"),
        F.col("event_id").cast("long").alias("event_seq"),
    )
    return conform(df)


def orders_lineitems(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders as cases: one 'Order placed' event, one 'Ship <flag><status>'
    event per line.  No event position exists: the order inside a case falls
    back to (ts, activity), total after cleaning."""
    placed = orders.select(
        F.col("o_orderkey").cast("string").alias("case_id"),
        F.lit("Order placed").alias("activity"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_orderpriority").alias("resource"),
        F.col("o_totalprice").cast("double").alias("requested_amount"),
        F.col("o_orderstatus").alias("application_type"),
    )
    shipped = lineitem.select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.concat(F.lit("Ship "), F.col("l_returnflag"), F.col("l_linestatus")).alias("activity"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.lit(None).cast("string").alias("resource"),
        F.lit(None).cast("double").alias("requested_amount"),
        F.lit(None).cast("string").alias("application_type"),
    )
    return conform(placed.unionByName(shipped))


def conversations_log(conversations: DataFrame) -> DataFrame:
    """Conversations: case = conversation, activity = role, order = turn.

    There is no clock; the turn number becomes whole seconds after the epoch
    so that every sequence operator sees the true turn order (durations and
    waits are then in turn units and carry no business meaning).
    """
    df = conversations.select(
        F.col("conv_id").cast("string").alias("case_id"),
        F.col("role").alias("activity"),
        F.timestamp_seconds(F.col("turn")).cast("timestamp_ntz").alias("ts"),
        F.col("turn").cast("long").alias("event_seq"),
    )
    return conform(df)


def main_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter the registered queries use (events seen as user-weeks)."""
    return events_user_week(table(spark, sf_dir, "events"))
