"""Distributed positions and exact quantiles (no single-partition window).

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task,
and ``Window.partitionBy(group)`` puts a hot group into one task.  Here rows
are range-partitioned on (group, order): Spark samples the keys, so a group
holding a third of the rows is spread over about a third of the partitions.
Each partition is sorted, rows get their in-partition index, and the rows per
(group, partition) -- a table of at most groups x partitions rows -- give
every partition its offset inside its group.

The range-partitioned data is checkpointed into the shared checkpoint folder
so that the count pass and the offset join see one and the same layout (and
survive executor loss).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.util import checkpointed
from caseflow.session import shuffle_partitions


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def positions(df: DataFrame, order: list, group: list | tuple = (),
              name: str = "pos", total: str | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of the row inside its ``group`` under
    ``order`` (a list of column names or sort expressions such as
    ``F.desc('n')``); ``group`` is a key with few values (a label).  ``order`` should be total; among exact ties the
    positions are a permutation of the tied rows.  ``total`` optionally
    names a column receiving the group size."""
    group = list(group)
    order = [_col(c) for c in order]
    n = num_partitions or shuffle_partitions(df.sparkSession)
    keys = [F.col(g) for g in group] + order
    # The range exchange samples its input in a separate job; keep the input
    # cached just until the checkpoint is written so it is computed once.
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        keyed = (src.repartitionByRange(n, *keys)
                   .sortWithinPartitions(*keys)
                   .withColumn("_pid", F.spark_partition_id())
                   .withColumn("_mid", F.monotonically_increasing_id()))
        keyed = checkpointed(keyed)
    finally:
        src.unpersist()

    stats = keyed.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_cnt"),
                                              F.min("_mid").alias("_base"))
    w = Window.partitionBy(*group).orderBy("_pid") if group else Window.orderBy("_pid")
    # ``stats`` has at most |groups| x n rows; the global case (no group) is n
    # rows, so a single-partition window here is over n rows, not the data.
    stats = stats.withColumn(
        "_before", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0)))
    if total:
        wt = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        stats = stats.withColumn(total, F.sum("_cnt").over(wt))
    stats = stats.drop("_cnt")
    # ranges keep a group together, so there are at most groups + n rows
    out = keyed.join(F.broadcast(stats), [*group, "_pid"], "inner")
    out = out.withColumn(name, (F.col("_before") + F.col("_mid") - F.col("_base") + 1).cast("long"))
    return out.drop("_pid", "_mid", "_base", "_before")


# Value buckets per factor of two; a bucket spans a relative width of 0.02 %.
BUCKETS_PER_OCTAVE = 4096
_OFFSET = 8_000_000  # above the largest bucket number of a finite double


def _bucket(v: Column) -> Column:
    """An order-preserving whole number for a double: values in order never
    have buckets out of order, so buckets can be counted before values."""
    size = F.least(F.greatest(F.floor(F.log2(F.abs(v)) * BUCKETS_PER_OCTAVE), F.lit(1 - _OFFSET)),
                   F.lit(_OFFSET - 1)) + _OFFSET
    return (F.when(F.isnan(v), F.lit(2 * _OFFSET + 1)).when(v == 0, F.lit(0))
            .when(v > 0, size).otherwise(-size).cast("long"))


_FROM_BUCKETS = {  # aggregates of the values from the sums of a group's buckets
    "count": lambda: F.col("_n"),
    "sum": lambda: F.col("_sum"),
    "avg": lambda: F.col("_sum") / F.col("_n"),
}


def quantiles(df: DataFrame, value: str, probs: dict, group: list | tuple = (),
              exact: bool = True, accuracy: int = 100_000, extra: dict | None = None,
              weight: str | None = None) -> DataFrame:
    """One row per group with one DOUBLE column per entry of ``probs``
    (``{'median': 0.5, 'p90': 0.9}``), linear interpolation between the two
    nearest ranks (numpy's default).  NULL values are ignored.

    ``extra`` adds ``F.avg``, ``F.sum`` or ``F.count`` of the value
    (``{'mean': F.avg}``).  ``exact=False`` uses ``percentile_approx`` (a
    bounded sketch per group).  ``weight`` names a column with the number of
    times that a row's value counts, for values that are counted already.

    Exact results come from one lazy plan of any size: (group, value) counts
    (ties collapse map-side), counts per value bucket, the buckets that hold
    a wanted rank (at most two per probability), and the ranks inside those
    buckets only.  No window is wider than the buckets of a group or the
    distinct values of a bucket, so neither a hot group nor ties gather in
    one task, and no job runs before the result is asked for.
    """
    group = list(group)
    names = list(probs)
    extra = extra or {}
    vals = _values(df, value, group, weight)
    if not exact:
        if weight:
            vals = vals.select(*group, "_v", F.explode(F.array_repeat(F.lit(1), F.col("_w").cast("int"))))
        arr = F.percentile_approx("_v", [float(probs[k]) for k in names], accuracy)
        agg = vals.groupBy(*group).agg(arr.alias("_q"),
                                       *[fn(F.col("_v")).alias(k) for k, fn in extra.items()])
        return agg.select(*group, *[F.col("_q")[i].alias(k) for i, k in enumerate(names)],
                          *extra.keys())
    # group keys as one struct: joins treat NULL keys as equal, like groupBy
    key = F.struct(*[F.col(g) for g in group]) if group else F.struct(F.lit(0).alias("_all"))
    times = F.sum("_w") if weight else F.count(F.lit(1))
    counts = (vals.select(key.alias("_g"), "_v", "_w").groupBy("_g", "_v").agg(times.alias("_c"))
              .withColumn("_b", _bucket(F.col("_v"))))
    buckets = counts.groupBy("_g", "_b").agg(F.sum("_c").alias("_c"), F.sum(F.col("_v") * F.col("_c")).alias("_s"))
    whole = Window.partitionBy("_g")
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("_n") - 1) * float(p)), F.ceil((F.col("_n") - 1) * float(p)))
        for p in probs.values()])))
    wanted = (buckets.withColumn("_n", F.sum("_c").over(whole)).withColumn("_sum", F.sum("_s").over(whole))
              .withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
              .withColumn("_ks", F.filter(ranks, lambda k: (k >= F.col("_before"))
                                          & (k < F.col("_before") + F.col("_c"))))
              .filter(F.size("_ks") > 0)
              .select(F.col("_g").alias("_wg"), F.col("_b").alias("_wb"), "_n", "_sum", "_before", "_ks"))
    inside = Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (counts.join(wanted, F.col("_g").eqNullSafe(F.col("_wg")) & (F.col("_b") == F.col("_wb")))
             .withColumn("_to", F.col("_before") + F.sum("_c").over(inside))
             .select("_g", "_n", "_sum", "_v", F.explode(F.filter(
                 "_ks", lambda k: (k < F.col("_to")) & (k >= F.col("_to") - F.col("_c")))).alias("_k")))
    aggs = [F.max("_n").alias("_n"), F.max("_sum").alias("_sum")]
    for k in names:
        h = (F.col("_n") - 1) * F.lit(float(probs[k]))
        aggs += [F.max(F.when(F.col("_k") == F.floor(h), F.col("_v"))).alias(f"_lo_{k}"),
                 F.max(F.when(F.col("_k") == F.ceil(h), F.col("_v"))).alias(f"_hi_{k}")]
    picked = found.groupBy("_g").agg(*aggs)
    cols = []
    for k in names:
        h = (F.col("_n") - 1) * F.lit(float(probs[k]))
        cols.append((F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (h - F.floor(h))).alias(k))
    return picked.select(*[F.col("_g")[g].alias(g) for g in group], *cols,
                         *[_FROM_BUCKETS[fn.__name__]().alias(k) for k, fn in extra.items()])


def _values(df: DataFrame, value: str, group: list, weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    return (df.select(*group, F.col(value).cast("double").alias("_v"), w.alias("_w"))
            .filter(F.col("_v").isNotNull()))


def scalar_quantile(df: DataFrame, value: str, p: float, exact: bool = True, weight: str | None = None) -> DataFrame:
    """1-row DataFrame with column ``q``: the ``p`` quantile over all rows."""
    return quantiles(df, value, {"q": p}, (), exact, weight=weight)


def running_sums(df: DataFrame, order: list, cols: list, prefix: str = "cum_",
                 num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``cols`` over the whole table under
    ``order`` (total order expected), without a single-partition window:
    range partitions get their offsets from per-partition totals (n rows),
    then each partition accumulates its own rows."""
    order = [_col(c) for c in order]
    n = num_partitions or shuffle_partitions(df.sparkSession)
    keyed = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id()))
    keyed = checkpointed(keyed)
    totals = keyed.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # n rows
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0))
                                      .alias(f"_b_{c}") for c in cols])
    wl = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(F.broadcast(offsets), "_pid", "inner")
    for c in cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_b_{c}") + F.sum(c).over(wl))
    return out.drop("_pid", "_mid", *[f"_b_{c}" for c in cols])
