"""Numbers behind the charts (CHT-1..8).  No drawing: each chart becomes a
small DataFrame a dashboard can plot.

Scalars (min/max/quantiles) are 1-row aggregates attached by a broadcast
cross join; bins come from a ``sequence`` of fixed length, so every result
here is bounded by the number of bins/groups, never by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators.ranking import quantiles, scalar_quantile


def histogram(df: DataFrame, value: str, bins: int, clip_upper: float | None = None,
              with_median: bool = True, exact: bool = True) -> DataFrame:
    """Equal-width histogram between the min and max of the (clipped) values;
    the last bin is closed.  Empty bins are present with count 0.  When
    ``with_median`` is set, the median of the *unclipped* values is attached."""
    raw = df.select(F.col(value).cast("double").alias("_m"))
    x = F.col("_m")
    if clip_upper is not None:
        x = F.least(x, F.lit(float(clip_upper)))
    vals = raw.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    rng = vals.agg(F.min("_x").alias("_lo0"), F.max("_x").alias("_hi0"))
    # numpy widens an empty range by 0.5 on each side
    rng = rng.select(
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
        F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    norm = F.lit(float(bins)) / (F.col("_hi") - F.col("_lo"))
    idx = F.least(F.floor((F.col("_x") - F.col("_lo")) * norm), F.lit(bins - 1)).cast("int")
    counts = (vals.crossJoin(F.broadcast(rng)).select(idx.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    grid = (F.broadcast(rng).select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
                                    .alias("bin")))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    out = (grid.join(F.broadcast(counts), "bin", "left")
           .select(F.col("bin").cast("int").alias("bin"),
                   (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                   (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                   F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_cases")))
    if with_median:
        med = scalar_quantile(raw, "_m", 0.5, exact)
        out = out.crossJoin(F.broadcast(med.withColumnRenamed("q", "median")))
    return out


def box_stats(df: DataFrame, value: str, group: list | tuple = (), exact: bool = True,
              weight: str | None = None) -> DataFrame:
    """Quartiles, 1.5*IQR whiskers (the most extreme values inside the
    fences) and outlier count per group; ``weight`` as for ``quantiles``."""
    group = list(group)
    q = quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group, exact,
                  extra={"n": F.count}, weight=weight)
    q = q.withColumn("_iqr", F.col("q3") - F.col("q1")) \
         .withColumn("_lo_f", F.col("q1") - 1.5 * F.col("_iqr")) \
         .withColumn("_hi_f", F.col("q3") + 1.5 * F.col("_iqr"))
    times = F.col(weight) if weight else F.lit(1)
    base = df.select(*group, F.col(value).cast("double").alias("_v"), times.alias("_c")).filter(F.col("_v").isNotNull())
    # equal values collapse first, so a hot group meets its row of quartiles
    # as (value, count) rows
    if not weight:
        base = base.groupBy(*group, "_v").agg(F.sum("_c").alias("_c"))
    joined = base.join(q, group, "inner") if group else base.crossJoin(F.broadcast(q))
    inside = (F.col("_v") >= F.col("_lo_f")) & (F.col("_v") <= F.col("_hi_f"))
    return joined.groupBy(*group).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("_c"))).cast("long").alias("n_outliers"))


def duration_box_by_outcome(cases: DataFrame, clip_days: float = 60.0, exact: bool = True) -> DataFrame:
    """CHT-5 on durations clipped at ``clip_days`` per outcome."""
    clipped = cases.select("outcome", F.least(F.col("duration_days"), F.lit(clip_days))
                           .alias("duration_clipped"))
    return box_stats(clipped, "duration_clipped", ["outcome"], exact)


def breach_by_month(cases: DataFrame) -> DataFrame:
    """CHT-4: SLA-breach rate per start month, peak month flagged (the first
    month on a tie)."""
    rates = cases.groupBy("start_month").agg(F.avg("sla_breach").alias("breach_rate"),
                                             F.count(F.lit(1)).alias("n_cases"))
    peak = rates.orderBy(F.desc("breach_rate"), F.asc("start_month")).limit(1) \
                .select("start_month", F.lit(1).alias("is_peak"))
    return (rates.join(F.broadcast(peak), "start_month", "left")
            .select("start_month", "breach_rate", "n_cases",
                    F.coalesce("is_peak", F.lit(0)).cast("int").alias("is_peak")))


def quantile_edges(df: DataFrame, value: str, q: int = 5, exact: bool = True) -> DataFrame:
    """Equal-frequency edges (1 row, array ``edges``), duplicates merged."""
    probs = {f"e{i}": i / q for i in range(q + 1)}
    qs = quantiles(df, value, probs, (), exact)
    return qs.select(F.array_distinct(F.array(*[F.col(k) for k in probs])).alias("edges"))


def breach_by_amount_quintile(cases: DataFrame, value: str = "requested_amount",
                              q: int = 5, exact: bool = True) -> DataFrame:
    """CHT-6: breach rate per equal-frequency amount bucket (right-closed,
    lowest value included, duplicate edges merged)."""
    base = cases.filter(F.col(value).isNotNull())
    edges = quantile_edges(base, value, q, exact)
    x = F.col(value).cast("double")
    bucket = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < x)))
    return (base.crossJoin(F.broadcast(edges))
            .select(bucket.cast("int").alias("bucket"),
                    F.element_at("edges", bucket).alias("lower_edge"),
                    # one merged edge (all values equal): the bucket is [v, v]
                    F.element_at("edges", F.least(bucket + 1, F.size("edges")))
                    .alias("upper_edge"), "sla_breach")
            .groupBy("bucket", "lower_edge", "upper_edge")
            .agg((F.avg("sla_breach") * 100).alias("breach_rate_pct"),
                 F.count(F.lit(1)).alias("n_cases"))
            .withColumn("label", F.concat(F.lit("Q"), F.col("bucket").cast("string"))))


def event_volume_by_month(log: DataFrame) -> DataFrame:
    """CHT-7: events per calendar month."""
    return (log.groupBy(F.date_format(F.date_trunc("month", "ts"), "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("n_events")))
