"""Streaming: live aggregates equal the batch operators; the refresher
writes the dashboard tables and a replayed epoch does not double events."""

from __future__ import annotations

import os
import shutil

from conftest import SF001

from caseflow.model import EVENTS_MODEL
from caseflow.operators import clean as cl
from caseflow.operators import variants as vr
from caseflow.sources import adapters
from caseflow.streaming import live


def test_live_activity_frequency_equals_batch(spark, tmp_dir):
    stream = adapters.events_user_week(live.file_stream(spark, SF001, glob="events*.parquet"))
    got = live.run_to_table(live.live_activity_frequency(stream), os.path.join(tmp_dir, "act"),
                            os.path.join(tmp_dir, "ck"))
    want = vr.activity_frequency(cl.clean(adapters.main_log(spark, SF001), ()))
    assert sorted(map(tuple, got.collect())) == \
        sorted((r["activity"], r["n_events"]) for r in want.collect())


def test_refresh_job(spark, tmp_dir):
    src = os.path.join(tmp_dir, "incoming")
    os.makedirs(src)
    shutil.copy(os.path.join(SF001, "events.parquet"), os.path.join(src, "part-0.parquet"))
    raw = adapters.events_user_week(live.file_stream(spark, src))
    live.refresh(raw, os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "out"),
                 os.path.join(tmp_dir, "ck"), EVENTS_MODEL)
    out = spark.read.parquet(os.path.join(tmp_dir, "out", "event_log_cleaned"))
    n_events = spark.read.parquet(os.path.join(SF001, "events.parquet")).count()
    assert out.count() == n_events
    rep = spark.read.parquet(os.path.join(tmp_dir, "out", "bottleneck_report")).collect()
    assert len(rep) == 1 and rep[0]["top_bottleneck"] is not None


def test_late_events_and_late_copies_equal_batch(spark, tmp_dir):
    """Four files, one micro-batch each: the third holds events a month late,
    the fourth a late copy; the stream counts what the batch job counts."""
    src = os.path.join(tmp_dir, "late")
    rows = [[("a", "x", "2024-03-01 10:00:00"), ("a", "y", "2024-03-01 11:00:00")],
            [("b", "x", "2024-03-09 10:00:00")],
            [("c", "x", "2024-02-02 10:00:00"), ("c", None, "2024-02-02 10:00:00")],
            [("a", "x", "2024-03-01 10:00:00"), ("d", "y", "2024-01-01 00:00:00")]]
    schema = "case_id string, activity string, ts timestamp_ntz"
    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, "case_id string, activity string, ts string")
        df.withColumn("ts", df.ts.cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
    stream = live.file_stream(spark, src, schema=schema, max_files_per_trigger=1)
    act = live.run_to_table(live.live_activity_frequency(stream), os.path.join(tmp_dir, "a"),
                            os.path.join(tmp_dir, "cka")).collect()
    vol = live.run_to_table(live.live_event_volume(stream), os.path.join(tmp_dir, "v"),
                            os.path.join(tmp_dir, "ckv")).collect()
    assert {r.activity: r.n_events for r in act} == {"x": 3, "y": 2}
    assert {r.month: r.n_events for r in vol} == {"2024-03": 3, "2024-02": 1, "2024-01": 1}
