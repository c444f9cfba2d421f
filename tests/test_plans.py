"""Plan checks: no Python UDFs, pruned scans, no single-partition window
over unreduced data in the registered queries."""

from __future__ import annotations

import pytest
from conftest import SF001

import __spark_entry__ as E

CHEAP = ["cln_clean_log", "win_transitions", "cas_case_table", "var_case_variants",
         "rwk_prevalence", "cnf_case_conformance", "cht_event_volume", "kpi_outcome_sla",
         "btn_transition_waits"]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHEAP)
def test_no_python_udf(spark, name):
    txt = plan_text(E.queries()[name](spark, SF001))
    assert "PythonUDF" not in txt and "BatchEvalPython" not in txt and "ArrowEvalPython" not in txt


@pytest.mark.parametrize("name", ["win_transitions", "rwk_prevalence",
                                  "cht_event_volume", "btn_transition_waits",
                                  "cnf_case_conformance"])
def test_scan_reads_only_needed_columns(spark, name):
    """Sequence/variant/rework analyses need neither the JSON props nor the
    value column: the parquet scan must not read them."""
    txt = plan_text(E.queries()[name](spark, SF001))
    schemas = [ln for ln in txt.splitlines() if "ReadSchema" in ln]
    assert schemas, txt
    for ln in schemas:
        assert "props" not in ln and "value:double" not in ln, ln


def test_transitions_window_is_partitioned_by_case_and_slice(spark):
    df = E.queries()["win_transitions"](spark, SF001)
    txt = plan_text(df)
    assert "Window" in txt
    assert "SinglePartition" not in txt


@pytest.mark.parametrize("name", ["cas_case_table", "cnf_case_conformance", "rwk_case_flags",
                                  "win_transitions", "adp_user_transitions"])
def test_no_single_partition_exchange(spark, name):
    """Per-case work never funnels the log through one partition."""
    txt = plan_text(E.queries()[name](spark, SF001))
    assert "SinglePartition" not in txt, txt


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "bottleneck_score" in df.columns


def test_every_query_has_oracle_or_is_model(spark):
    from caseflow.plans.queries import QUERIES

    sql = E.oracle_sql()
    assert {k for k in QUERIES if k not in sql} == {
        "ml_model_comparison", "ml_feature_importance", "ml_roc_points", "ml_confusion",
        "kpi_bottleneck_report_models"}


def test_entry_without_the_optional_subpackage():
    """The training-data folders can be missing: the rest is registered."""
    import os
    import shutil
    import subprocess
    import sys
    import tempfile

    top = os.path.dirname(os.path.abspath(E.__file__))
    copy = tempfile.mkdtemp(prefix="caseflow-part-")
    shutil.copytree(os.path.join(top, "caseflow"), os.path.join(copy, "caseflow"),
                    ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(os.path.join(top, "__spark_entry__.py"), copy)
    code = ("import __spark_entry__ as e; from caseflow.plans.queries import QUERIES; "
            "assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) <= set(QUERIES)")
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True,
                   env={**os.environ, "PYTHONPATH": copy})


@pytest.mark.parametrize("name", ["cas_case_table", "cas_duration_profile", "kpi_complexity",
                                  "cnf_breach_by_conformance", "cht_duration_box_by_outcome"])
def test_case_queries_expand_no_rows(spark, name):
    assert "Expand" not in plan_text(E.queries()[name](spark, SF001))


@pytest.mark.parametrize("name", ["cas_outcome_distribution", "cnf_breach_by_conformance",
                                  "ml_class_balance", "kpi_outcome_sla", "cas_completed_cases"])
def test_one_pruned_scan(spark, name):
    """Totals come from grouped rows and flags from the same row as breaches:
    the log is scanned once, without the columns only attributes need."""
    txt = plan_text(E.queries()[name](spark, SF001))
    schemas = [ln for ln in txt.splitlines() if "ReadSchema" in ln]
    assert len(schemas) == 1, txt
    if not name.startswith("ml_"):
        assert "props" not in schemas[0] and "value" not in schemas[0]


def test_variant_ranks_are_joined_without_a_broadcast_hint(spark):
    from caseflow.operators import variants as vr

    v = spark.createDataFrame([(str(i), 1 if i % 3 else 2, 0, 1) for i in range(30)],
                              "case_id string, d1 long, d2 long, n_events long")
    ranks = spark.createDataFrame([(1, 0, 1, "a", 20, 1), (2, 0, 1, "b", 10, 2)],
                                  "d1 long, d2 long, n_events long, variant string, n_cases long, variant_rank long")
    out = vr.attach_variants(v.select("case_id"), v, ranks)
    logical = out._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in logical and "UnresolvedHint" not in logical
    assert out.columns[0] == "case_id"
    assert {(r.variant, r.variant_rank, r.is_top3_variant) for r in out.collect()} == {("a", 1, 1), ("b", 2, 1)}


def test_entry_in_session_without_time_zone(spark):
    """The driver's session may have no zone set: entry must still work."""
    spark.conf.unset("spark.sql.session.timeZone")
    try:
        assert E.entry(spark).count() >= 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_variant_build_reads_only_needed_columns(spark):
    """The queries read materialised tables; the build of the digests behind
    them scans only what it needs."""
    from caseflow.plans import queries as Q

    txt = plan_text(Q._counts(spark, SF001))
    schemas = [ln for ln in txt.splitlines() if "ReadSchema" in ln]
    assert schemas and all("props" not in ln and "value:double" not in ln for ln in schemas)


def _initial(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan


def _subtree(node):
    out = [node]
    for i in range(node.children().size()):
        out += _subtree(node.children().apply(i))
    return out


def log_exchanges(df):
    """Exchanges below which nothing has been aggregated: they move the log."""
    return [n for n in _subtree(_initial(df)) if n.nodeName() == "Exchange"
            and not any("Aggregate" in m.nodeName() for m in _subtree(n))]


def test_bucketed_log_is_not_shuffled_again(spark):
    """Readers of the bucketed log: previous events, digests, variant texts and
    case facts move summaries only."""
    from caseflow.model import EVENTS_MODEL as M
    from caseflow.operators import cases as cs
    from caseflow.operators import clean as cl
    from caseflow.operators import digests as dg
    from caseflow.operators import variants as vr
    from caseflow.operators import waits
    from caseflow.operators.util import bucketed
    from caseflow.sources import adapters

    clean = cl.clean(adapters.main_log(spark, SF001), None, M.slice_hours)
    log = bucketed(clean, "clean-log", buckets=4)
    assert log.dtypes == clean.dtypes and log.exceptAll(clean).count() == 0 and log.count() == clean.count()
    plain = waits.transitions(clean, M)
    for build in (lambda x: waits.transitions(x, M), lambda x: waits.valid_transitions(waits.transitions(x, M), M),
                  dg.case_digests, vr.case_variants, lambda x: cs.case_aggregates(x, M)):
        assert not log_exchanges(build(log))
    assert waits.transitions(log, M).select(plain.columns).exceptAll(plain).count() == 0


def test_end_to_end_jobs_read_the_bucketed_log(spark):
    from caseflow.model import EVENTS_MODEL as M
    from caseflow.operators import waits
    from caseflow.plans.pipelines import run_discovery
    from caseflow.sources import adapters

    disc = run_discovery(adapters.main_log(spark, SF001), M)
    log = disc["event_log_cleaned"]
    assert not log_exchanges(waits.transitions(log, M))
    assert not log_exchanges(disc["activity_frequency"]) and not log_exchanges(disc["discovery_summary"])
