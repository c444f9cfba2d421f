"""Case facts that follow a growing log equal the batch job's."""

from __future__ import annotations

import os
import random

import pytest
from conftest import SF001
from golden import golden_raw

from caseflow.model import EVENTS_MODEL, REFERENCE_MODEL
from caseflow.operators import cases as cs
from caseflow.operators import casestate as st
from caseflow.operators import clean as cl
from caseflow.operators import conformance as cf
from caseflow.schema import conform
from caseflow.sources import adapters
from caseflow.streaming import casestore
from caseflow.streaming.casestore import CaseStore


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    got, want = (sorted(map(str, df.select(*cols).collect())) for df in (a, b))
    assert got == want


@pytest.mark.parametrize("model", [REFERENCE_MODEL])
def test_states_merge_like_the_whole(spark, model):
    log = conform(cl.clean(golden_raw(spark)))
    want = cs.case_aggregates(log, model)
    parts = [log.where(f"pmod(hash(activity, ts), 3) = {i}") for i in range(3)]
    states = [st.case_state(p, model) for p in parts]
    left = st.merge_states(st.merge_states(states[0].unionByName(states[1])).unionByName(states[2]))
    right = st.merge_states(states[0].unionByName(st.merge_states(states[1].unionByName(states[2]))))
    same(st.finished(left), want)
    same(st.finished(right), want)


def test_days_appended_one_by_one(spark, tmp_dir):
    """Three shuffled parts, one twice, a null and a bad row: the case table and
    the conformance of the store are the batch job's; the log has no copies."""
    raw = adapters.main_log(spark, SF001)
    store = CaseStore(spark, os.path.join(tmp_dir, "s"), EVENTS_MODEL, buckets=5)
    for i in (2, 0, 0, 1):
        store.append(raw.where(f"event_seq % 3 = {i}"))
    log = conform(cl.clean(raw, None, EVENTS_MODEL.slice_hours))
    same(store.log(), log)
    want = cs.case_aggregates(log, EVENTS_MODEL)
    same(store.aggregates(), want)
    same(cs.case_table(store.aggregates(), EVENTS_MODEL), cs.case_table(want, EVENTS_MODEL))
    same(cf.conformance(store.aggregates(), EVENTS_MODEL), cf.conformance(want, EVENTS_MODEL))


def rows(*r):
    return [(c, a, f"2024-01-{d:02d} 00:00:00", res, s) for c, a, d, res, s in r]


SCHEMA = "case_id string, activity string, ts string, resource string, event_seq long"


def test_only_touched_buckets_are_rewritten(spark, tmp_dir):
    store = CaseStore(spark, os.path.join(tmp_dir, "s"), buckets=8)
    store.append(spark.createDataFrame(rows(*[(f"c{i}", "x", 1, "r", i) for i in range(60)]), SCHEMA))
    before = store._manifest()
    told = store.append(spark.createDataFrame(rows(("c7", "y", 2, "r", 100)), SCHEMA))
    after = store._manifest()
    assert len(before) == 8 and told == {"buckets": 1, "redone": 0}
    assert sum(before[b] != after[b] for b in before) == 1
    got = {r.case_id: r for r in store.aggregates().collect()}
    assert len(got) == 60 and got["c7"].n_events == 2 and got["c7"].last_activity == "y"


def test_copies_late_and_early(spark, tmp_dir):
    """A later copy changes nothing; one that comes before the kept event
    replaces it and its case alone is computed again."""
    store = CaseStore(spark, os.path.join(tmp_dir, "s"), buckets=2)
    store.append(spark.createDataFrame(rows(("a", "x", 3, "late", 10), ("a", "y", 4, None, 11), ("b", "x", 1, "q", 1)), SCHEMA))
    assert store.append(spark.createDataFrame(rows(("a", "x", 3, "copy", 50), ("a", "x", 3, "copy", 51)), SCHEMA))["redone"] == 0
    log = {(r.case_id, r.activity): r.resource for r in store.log().collect()}
    assert log["a", "x"] == "late"
    told = store.append(spark.createDataFrame(rows(("a", "x", 3, "early", 2), ("a", "w", 1, "z", 60)), SCHEMA))
    assert told["redone"] == 1
    got = {r.case_id: r for r in store.aggregates().collect()}
    assert got["a"].n_events == 3 and got["a"].first_activity == "w" and got["a"].n_resources == 2
    assert {(r.case_id, r.activity): r.resource for r in store.log().collect()}["a", "x"] == "early"
    assert got["b"].n_events == 1


def test_many_appends_compact_and_equal_batch(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(casestore, "COMPACT", 2)
    rng = random.Random(2)
    events = rows(*[(f"c{rng.randint(0, 6)}", rng.choice("xyz"), rng.randint(1, 9), rng.choice(["u", "v", None]), i)
                    for i in range(80)])
    rng.shuffle(events)
    store = CaseStore(spark, os.path.join(tmp_dir, "s"), buckets=3)
    for i in range(0, 80, 20):
        store.append(spark.createDataFrame(events[i:i + 25], SCHEMA))  # five of the next part come early
    log = conform(cl.clean(spark.createDataFrame(events, SCHEMA)))
    same(store.aggregates(), cs.case_aggregates(log))
    assert max(len(v) for _, v in store._manifest().values()) <= 3


def test_unfinished_append_is_invisible(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "s")
    store = CaseStore(spark, path, buckets=2)
    store.append(spark.createDataFrame(rows(("a", "x", 1, None, 1)), SCHEMA))
    more = spark.createDataFrame(rows(("a", "y", 2, None, 2)), SCHEMA)
    write = CaseStore._write

    def breaks(self, df, kind, version):
        write(self, df, kind, version)
        if kind == "log":
            raise RuntimeError("lost")

    monkeypatch.setattr(CaseStore, "_write", breaks)
    with pytest.raises(RuntimeError):
        store.append(more)
    monkeypatch.setattr(CaseStore, "_write", write)
    again = CaseStore(spark, path, buckets=99)
    assert again.buckets == 2 and again.aggregates().first().n_events == 1
    again.append(more)
    assert again.aggregates().first().n_events == 2 and again.log().count() == 2


def test_empty(spark, tmp_dir):
    store = CaseStore(spark, os.path.join(tmp_dir, "s"))
    assert store.aggregates().count() == 0 and store.log().count() == 0
    assert store.append(spark.createDataFrame([], SCHEMA)) == {"buckets": 0, "redone": 0}
