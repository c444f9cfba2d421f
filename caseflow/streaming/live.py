"""The log operators on a growing log (Structured Streaming).

* :func:`live_activity_frequency` / :func:`live_event_volume` -- DSC-3 and
  CHT-7 as streaming aggregations.  Exact copies (case, activity, ts) are
  dropped however late they come, and no event is dropped for being late:
  the state holds the keys seen (keep it in the RocksDB state store on a
  cluster), so the result always equals the batch job's.
* :func:`append_new` -- every micro-batch is appended to the log store (one
  folder per epoch, overwritten on retry, so a replayed epoch never doubles
  events).
* :func:`refresh` -- appends what has arrived, then runs the batch jobs once
  over the store; meant to be scheduled, not to run at every trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.model import REFERENCE_MODEL, ProcessModel
from caseflow.schema import ACTIVITY, CASE, TS


def file_stream(spark, folder: str, fmt: str = "parquet", schema=None, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """New files in ``folder`` (optionally only names matching ``glob``) as a
    stream; the schema is taken from the files when not given."""
    r = spark.read.format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if schema is None:
        schema = r.load(folder).schema
    s = spark.readStream.format(fmt).schema(schema)
    if glob:
        s = s.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        s = s.option("maxFilesPerTrigger", max_files_per_trigger)
    return s.load(folder)


def _events(log: DataFrame) -> DataFrame:
    """Complete events, exact copies (case, activity, ts) dropped."""
    return log.dropna(subset=[CASE, ACTIVITY, TS]).dropDuplicates([CASE, ACTIVITY, TS])


def live_activity_frequency(log: DataFrame) -> DataFrame:
    """DSC-3 on a stream: events per activity (complete mode)."""
    return _events(log).groupBy(ACTIVITY).agg(F.count(F.lit(1)).alias("n_events"))


def live_event_volume(log: DataFrame) -> DataFrame:
    """CHT-7 on a stream: events per calendar month."""
    return (_events(log)
            .groupBy(F.date_format(F.date_trunc("month", TS), "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("n_events")))


def run_to_table(stream_df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available; the aggregate after the last micro-batch
    as a table under ``path`` (one folder per micro-batch)."""
    done: list[int] = []

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")
        done.append(epoch)

    q = (stream_df.writeStream.foreachBatch(keep).outputMode("complete")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    spark = stream_df.sparkSession
    if not done:
        return spark.createDataFrame([], stream_df.schema)
    return spark.read.parquet(f"{path.rstrip('/')}/epoch={max(done)}")


def append_new(raw_stream: DataFrame, store: str, checkpoint: str) -> None:
    """Append every event file that has arrived to the log store."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{store.rstrip('/')}/epoch={epoch}")

    (raw_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def refresh(raw_stream: DataFrame, store: str, out_dir: str, checkpoint: str,
            model: ProcessModel = REFERENCE_MODEL, fit_models: bool = False) -> dict:
    """Append what has arrived, then write all tables from the store."""
    from caseflow.plans.pipelines import run_bottleneck, run_discovery, write_outputs

    append_new(raw_stream, store, checkpoint)
    whole = raw_stream.sparkSession.read.parquet(store).drop("epoch")
    disc = run_discovery(whole, model)
    paths = write_outputs(disc, out_dir)
    bott = run_bottleneck(disc["event_log_cleaned"], disc["case_features"], model, fit=fit_models)
    return {**paths, **write_outputs(bott, out_dir)}
