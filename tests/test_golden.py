"""Hand-computed expectations on the golden log (reference model)."""

from __future__ import annotations

from golden import approx, by_case, golden_log, golden_raw

from caseflow.model import REFERENCE_MODEL as M
from caseflow.operators import cases as cs
from caseflow.operators import clean as cl
from caseflow.operators import conformance as cf
from caseflow.operators import rework as rw
from caseflow.operators import variants as vr
from caseflow.operators import waits


def test_cleaning_removes_dirty_rows_and_keeps_first_copy(spark):
    log = golden_log(spark)
    assert log.count() == 10
    a2 = log.filter("case_id = 'A' AND activity = 'O_Create Offer'").collect()
    assert len(a2) == 1 and a2[0]["resource"] == "u2"
    prof = cl.clean_profile(golden_raw(spark), log).first()
    assert prof["original_events"] == 13 and prof["removed_events"] == 3
    assert prof["unique_cases"] == 4 and prof["unique_activities"] == 8


def test_case_table(spark):
    ct = by_case(cs.build_case_table(golden_log(spark), M))
    exp = {
        "A": (1.125, 3, 3, 2, "Approved", 0, "1 - 0-7 days (Fast)", 0),
        "B": (20.0, 3, 2, 1, "Still Processing", 1, "3 - 15-21 days (Late)", 1),
        "C": (1 / 24, 2, 2, 1, "Unknown", 0, "1 - 0-7 days (Fast)", 0),
        "D": (69.0, 2, 2, 2, "Cancelled", 1, "5 - 30+ days (Critical)", 0),
    }
    for case, (days, n, nd, nr, outcome, breach, bucket, extra) in exp.items():
        r = ct[case]
        assert approx(r["duration_days"], days), case
        assert (r["n_events"], r["n_unique_activities"], r["n_resources"]) == (n, nd, nr), case
        assert r["outcome"] == outcome and r["sla_breach"] == breach, case
        assert r["duration_bucket"] == bucket and r["rework_events"] == extra, case
        assert r["sla_days"] == 14
    assert ct["A"]["start_dow"] == "Monday" and ct["A"]["start_month_name"] == "Jan"


def test_conformance(spark):
    aggs = cs.case_aggregates(golden_log(spark), M)
    conf = cf.conformance(aggs, M)
    got = {k: (v["is_conformant"], v["deviation_types"]) for k, v in by_case(conf).items()}
    assert got == {"A": (1, "none"), "B": (0, "bad_start,bad_end"),
                   "C": (0, "bad_start,wrong_order"), "D": (0, "bad_end,rework_detected")}
    devs = {r["deviation"]: r["n_cases"] for r in cf.deviation_breakdown(conf).collect()}
    assert devs == {"bad_start": 2, "bad_end": 2, "wrong_order": 1, "rework_detected": 1}
    rate = cf.conformance_rate(conf).first()
    assert approx(rate["conformance_rate_pct"], 25.0) and rate["non_conformant_cases"] == 3
    b = cf.breach_by_conformance(cs.case_table(aggs, M), conf).first()
    assert approx(b["breach_pct_conformant"], 0.0)
    assert approx(b["breach_pct_non_conformant"], 200 / 3)
    assert b["breach_ratio"] is None


def test_waits_and_bottlenecks(spark):
    valid = waits.valid_transitions(waits.transitions(golden_log(spark), M), M)
    got = sorted((r["activity"], round(r["waiting_hours"], 6)) for r in valid.collect())
    assert got == [("A_Cancelled", 1.0), ("A_Complete", 24.0), ("O_Create Offer", 3.0),
                   ("W_Call after offers", 240.0), ("W_Call after offers", 240.0)]
    st = waits.top_bottlenecks(waits.bottleneck_stats(valid, M), 10)
    rows = [(r["activity"], r["n_occurrences"], r["bottleneck_score"]) for r in
            st.orderBy("bottleneck_rank").collect()]
    assert rows == [("W_Call after offers", 2, 480.0), ("A_Complete", 1, 24.0),
                    ("O_Create Offer", 1, 3.0), ("A_Cancelled", 1, 1.0)]
    top = st.filter("bottleneck_rank = 1").first()
    assert top["total_wait_hours"] == top["bottleneck_score"]  # D3 identity
    assert approx(top["median_wait_hours"], 240.0) and approx(top["p90_wait_hours"], 240.0)


def test_rework(spark):
    counts = rw.activity_counts(golden_log(spark))
    prev = rw.rework_prevalence(counts).first()
    assert prev["cases_with_rework"] == 1 and prev["total_cases"] == 4
    assert approx(prev["rework_pct"], 25.0) and prev["rework_events"] == 1
    by = rw.rework_by_activity(counts).collect()
    assert [(r["activity"], r["cases_with_rework"], r["avg_repeats"]) for r in by] == \
        [("W_Call after offers", 1, 2.0)]


def test_variants_rank_ties_by_text(spark):
    log = golden_log(spark)
    ranks = vr.variant_ranks(vr.variant_counts(vr.case_variants(log)))
    got = [(r["variant_rank"], r["variant"]) for r in ranks.orderBy("variant_rank").collect()]
    texts = sorted(r["variant"] for r in ranks.collect())
    assert [t for _, t in got] == texts          # every count is 1 -> text order
    assert [k for k, _ in got] == [1, 2, 3, 4]
    assert "A_Create Application → O_Create Offer → A_Complete" in texts


def test_completed_only_drops_still_processing(spark):
    m = M.with_(completed_only=True)
    ct = cs.build_case_table(golden_log(spark), m)
    assert sorted(r["case_id"] for r in ct.collect()) == ["A", "C", "D"]
    assert cs.completed_cases(cs.build_case_table(golden_log(spark), M), M).count() == 3
