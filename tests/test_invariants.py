"""Invariants on the driver's events log."""

from __future__ import annotations

import pytest
from conftest import SF001

from caseflow.model import EVENTS_MODEL as M
from caseflow.operators import cases as cs
from caseflow.operators import charts as ch
from caseflow.operators import clean as cl
from caseflow.operators import conformance as cf
from caseflow.operators import rework as rw
from caseflow.operators import variants as vr
from caseflow.operators import waits
from caseflow.sources import adapters


@pytest.fixture(scope="module")
def log(spark):
    return cl.clean(adapters.main_log(spark, SF001)).cache()


@pytest.fixture(scope="module")
def cases(spark, log):
    return cs.build_case_table(log, M).cache()


def test_variant_counts_sum_to_cases(log, cases):
    counts = vr.variant_counts(vr.case_variants(log))
    assert counts.groupBy().sum("n_cases").first()[0] == cases.count()


def test_rework_identity(log, cases):
    flags = rw.case_rework_flags(rw.activity_counts(log))
    j = cases.select("case_id", "rework_events", "has_rework").join(
        flags.withColumnRenamed("rework_events", "r2").withColumnRenamed("has_rework", "h2"),
        "case_id")
    assert j.filter("rework_events <> r2 OR has_rework <> h2").count() == 0
    assert j.count() == cases.count()


def test_conformant_iff_none(log):
    conf = cf.conformance(cs.case_aggregates(log, M), M)
    assert conf.filter("(is_conformant = 1) <> (deviation_types = 'none')").count() == 0


def test_histogram_sums_to_cases(cases):
    h = ch.histogram(cases, "duration_days", 40, 60.0)
    assert h.count() == 40
    assert h.groupBy().sum("n_cases").first()[0] == cases.count()


def test_score_equals_total(log):
    st = waits.bottleneck_stats(waits.valid_transitions(waits.transitions(log, M), M), M)
    for r in st.collect():
        assert abs(r["bottleneck_score"] - r["total_wait_hours"]) < 1e-6 * max(1, r["total_wait_hours"])


def test_results_independent_of_partitioning(spark, log):
    """Shuffled input and other partition counts give the same answers."""
    base = sorted(map(tuple, vr.case_variants(log).collect()))
    shuffled = log.repartition(7).orderBy("event_seq", ascending=False)
    again = sorted(map(tuple, vr.case_variants(shuffled).collect()))
    assert base == again
    t1 = sorted(map(tuple, waits.transitions(log, M).select(
        "case_id", "event_seq", "prev_activity", "position").collect()))
    t2 = sorted(map(tuple, waits.transitions(shuffled, M.with_(slice_hours=1)).select(
        "case_id", "event_seq", "prev_activity", "position").collect()))
    assert t1 == t2
