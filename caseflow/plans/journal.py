"""A raw, uncleaned log for the queries that exercise the cleaning rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orders_journal(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders and their lines as a raw, uncleaned log with XES-style names.

    A declared adapter that makes every cleaning rule do work: each order is
    placed (``signup``) and each line is an event whose kind follows its flags,
    5 days per line number and up to 10 more days after the order.  Every third
    order is reported twice, six-numbered ``N``/``O`` lines have no activity,
    seven-numbered lines no readable time, every fifth order no goal, every
    seventh no application type; goals hold runs of spaces.
    """
    key = F.col("o_orderkey")
    placed = orders.select(
        key.cast("string").alias("case:concept:name"), F.lit("signup").alias("concept:name"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("time:timestamp"),
        F.col("o_orderstatus").alias("org:resource"),
        F.when(key % 5 != 0, F.concat(F.lit("  "), "o_orderpriority", F.lit("  goal\n"))).alias("case:LoanGoal"),
        F.col("o_totalprice").cast("double").alias("case:RequestedAmount"),
        F.when(key % 7 != 0, F.col("o_orderstatus")).alias("case:ApplicationType"),
        F.lit(0).cast("long").alias("event_seq"))
    again = placed.where("`case:concept:name` % 3 = 0").withColumn("event_seq", F.lit(100).cast("long")) \
                  .withColumn("org:resource", F.lit("copy"))
    flags = F.concat("l_returnflag", "l_linestatus")
    kind = (F.when(F.col("l_returnflag") == "A", "purchase").when(flags == "RF", "error")
            .when(flags == "RO", "click").when((flags == "NO") & (F.col("l_linenumber") == 6), F.lit(None))
            .otherwise("view"))
    days = F.col("l_linenumber") * 5 + F.pmod(F.datediff("l_shipdate", "o_orderdate"), F.lit(11))
    when = F.to_timestamp_ntz(F.date_format("o_orderdate", "yyyy-MM-dd")) + F.make_dt_interval(
        days.cast("int"), F.col("l_linenumber").cast("int"))
    lines = lineitem.join(orders.select("o_orderkey", "o_orderdate"),
                          F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("case:concept:name"), kind.alias("concept:name"),
        F.when(F.col("l_linenumber") == 7, F.lit("not a date"))
        .otherwise(F.date_format(when, "yyyy-MM-dd HH:mm:ss")).alias("time:timestamp"),
        flags.alias("org:resource"), F.lit(None).cast("string").alias("case:LoanGoal"),
        F.lit(None).cast("double").alias("case:RequestedAmount"),
        F.lit(None).cast("string").alias("case:ApplicationType"),
        F.col("l_linenumber").cast("long").alias("event_seq"))
    return placed.unionByName(again).unionByName(lines)
