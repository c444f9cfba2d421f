"""Connected components of links by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp`` (the smallest node it reaches) of every node of the
    links ``a``, ``b``.  Every step is an aggregation with partial sums and a
    join that adaptive execution splits at hot nodes; the links of a step are
    written, so the plan does not grow."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct(), "links")
    before = None
    while True:
        # large star: larger neighbours of a node to its smallest neighbour
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours of a node, and itself, to the smallest
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = (edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        edges = written(edges, "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # now every node points to the smallest of its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        edges.select("v", "v").distinct())
