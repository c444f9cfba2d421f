"""Case facts that follow a growing log without being computed anew.

The store is cut into buckets by a hash of the case id.  For each bucket it
keeps the events seen (so that copies, however late, are found) and one state
a case (``operators.casestate``).  :meth:`CaseStore.append` reads and rewrites
the buckets that the new events touch and no other:

* an event not seen before is merged into its case's state;
* a copy of a seen event changes nothing, unless it comes before the one that
  was kept (by position, then by its other columns: the rule of cleaning);
  then that case, and only it, is computed again from its events.

Every append writes new folders and, last, a manifest that names the folders
of each bucket.  Readers take the newest finished manifest, so an append that
fails, or that runs again, is invisible until it is done and never counts
twice.  Appends to one store must not run at the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.model import REFERENCE_MODEL, ProcessModel
from caseflow.operators import casestate as st
from caseflow.operators import clean as cl
from caseflow.operators.util import materialised
from caseflow.schema import ACTIVITY, CASE, SLICE, TS, conform

KEY = [CASE, SLICE, ACTIVITY, TS]
COMPACT = 8  # folders of events a bucket has at most before they become one


class CaseStore:
    """``path`` is any folder that the cluster shares; ``buckets`` is fixed
    when the store is made (rows a bucket: events / buckets)."""

    def __init__(self, spark: SparkSession, path: str, model: ProcessModel = REFERENCE_MODEL, buckets: int = 64):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        made = self._versions("manifest")
        self.buckets = self.spark.read.parquet(self._at("manifest", made[-1])).first().of if made else buckets
        empty = cl.clean(conform(spark.createDataFrame([], f"{CASE} string")), None, model.slice_hours)
        self.log_schema, self.state_schema = empty.schema, st.case_state(empty, model).schema

    # ---- folders -----------------------------------------------------------------

    def _at(self, kind: str, version: int, bucket: int | None = None) -> str:
        return f"{self.path}/{kind}/version={version}" + ("" if bucket is None else f"/bucket={bucket}")

    def _versions(self, kind: str, finished: bool = True) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(conf)
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top)]
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and (
            not finished or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))))

    def _manifest(self) -> dict[int, tuple[int, list[int]]]:
        """Of each bucket: the version of its states and those of its events."""
        made = self._versions("manifest")
        if not made:
            return {}
        return {r.bucket: (r.state, list(r.log)) for r in self.spark.read.parquet(self._at("manifest", made[-1])).collect()}

    def _read(self, schema, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _events(self, manifest: dict, buckets) -> DataFrame:
        return self._read(self.log_schema, [self._at("log", v, b) for b in buckets if b in manifest for v in manifest[b][1]])

    def _states(self, manifest: dict, buckets) -> DataFrame:
        return self._read(self.state_schema, [self._at("state", manifest[b][0], b) for b in buckets if b in manifest])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(CASE), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, df: DataFrame, kind: str, version: int) -> None:
        rows = df.withColumn("bucket", self._bucket()).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(self._at(kind, version))

    # ---- reading -----------------------------------------------------------------

    def log(self) -> DataFrame:
        """The clean log of all that was appended."""
        manifest = self._manifest()
        return cl.dedup_events(self._events(manifest, manifest), KEY)

    def aggregates(self) -> DataFrame:
        """What :func:`cases.case_aggregates` gives for :meth:`log`, from the states."""
        manifest = self._manifest()
        return st.finished(self._states(manifest, manifest))

    # ---- appending ---------------------------------------------------------------

    def append(self, events: DataFrame) -> dict:
        """Add raw or canonical events; the buckets rewritten and the cases
        that had to be computed again."""
        new = cl.clean(events, None, self.model.slice_hours)
        new = materialised(conform(new).select(*[F.col(f.name).cast(f.dataType) for f in self.log_schema]), "new-events")
        touched = sorted(r.bucket for r in new.select(self._bucket()).distinct().collect())
        if not touched:
            return {"buckets": 0, "redone": 0}
        version = 1 + max([0, *self._versions("log", False), *self._versions("state", False), *self._versions("manifest", False)])
        manifest = self._manifest()
        seen = cl.dedup_events(self._events(manifest, touched), KEY)
        rest = [c for c in new.columns if c not in KEY]
        payload = F.struct("event_seq", *[c for c in rest if c != "event_seq"])
        kept = seen.select(*KEY, payload.alias("_kept"))
        told = new.join(kept, KEY, "left").withColumn("_earlier", F.coalesce(payload < F.col("_kept"), F.lit(False)))
        fresh = materialised(told.where("_kept is null or _earlier").drop("_kept"), "fresh-events")
        redo = materialised(fresh.where("_earlier").select(CASE).distinct(), "redo-cases")
        fresh_events = fresh.drop("_earlier").select(*new.columns)
        whole = cl.dedup_events(seen.select(*new.columns).unionByName(fresh_events), KEY)
        again = st.case_state(whole.join(redo, CASE, "left_semi"), self.model)
        added = st.case_state(fresh_events.join(redo, CASE, "left_anti"), self.model)
        old = self._states(manifest, touched).join(redo, CASE, "left_anti")
        self._write(st.merge_states(old.unionByName(added).unionByName(again)), "state", version)

        # a bucket with many folders of events gets one; the others get one more
        full = [b for b in touched if len(manifest.get(b, (0, []))[1]) >= COMPACT]
        changed = {r.bucket for r in fresh_events.select(self._bucket()).distinct().collect()}
        parts = fresh_events.where(~self._bucket().isin(full)) if full else fresh_events
        if full:
            parts = parts.unionByName(whole.where(self._bucket().isin(full)).select(*new.columns))
        self._write(parts, "log", version)
        for b in touched:
            logs = manifest.get(b, (0, []))[1]
            manifest[b] = version, [version] if b in full else [*logs, version] if b in changed else logs
        rows = [(b, self.buckets, s, v) for b, (s, v) in sorted(manifest.items())]
        (self.spark.createDataFrame(rows, "bucket int, of int, state long, log array<long>").coalesce(1)
         .write.mode("overwrite").parquet(self._at("manifest", version)))
        return {"buckets": len(touched), "redone": redo.count()}
