"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.schema import ACTIVITY, CASE, SEQ, SLICE, TS
from caseflow.session import scratch_table, shuffle_partitions


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir`` (never a
    local checkpoint): cuts lineage and freezes nondeterministic columns."""
    from caseflow.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def share_of_all(per: DataFrame, key: str, count: str, share: str = "share_pct") -> DataFrame:
    """``key, count`` and the share of all in per cent.  The total is the sum
    of the grouped rows (one per value of ``key``), not another pass."""
    total = F.sum(count).over(Window.partitionBy(F.lit(0)))
    return per.select(key, count, (F.col(count) / total * 100).alias(share))


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and
    read back: readers prune its columns, and its plan is one scan."""
    from caseflow.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(log: DataFrame, name: str, keys: tuple = (CASE, SLICE), order: tuple = (TS, SEQ, ACTIVITY),
             buckets: int | None = None) -> DataFrame:
    """``log`` written once as a table bucketed by ``keys`` and sorted, below the
    shared checkpoint folder, and read back: windows and aggregations by these
    keys (or more) read it without a shuffle of the log.  The one shuffle is
    that of the write.  With case and time slice as keys, a case holding a large
    share of the log is spread over as many buckets as it has slices."""
    spark = log.sparkSession
    n = buckets or shuffle_partitions(spark)
    table, path = scratch_table(spark, name)
    order = [c for c in order if c in log.columns and c not in keys]
    # dealt like the buckets, so that each task writes the files of its own
    (log.repartition(n, *keys).write.option("path", path).format("parquet")
     .bucketBy(n, *keys).sortBy(*keys, *order).saveAsTable(table))
    return spark.table(table)
