"""End-to-end jobs agree with the single-operator queries."""

from __future__ import annotations

from conftest import SF001

import __spark_entry__ as E
from caseflow.model import EVENTS_MODEL
from caseflow.plans.pipelines import run_bottleneck, run_discovery, write_outputs
from caseflow.sources import adapters


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_pipeline_matches_queries(spark, tmp_dir):
    raw = adapters.main_log(spark, SF001)
    disc = run_discovery(raw, EVENTS_MODEL)
    bott = run_bottleneck(disc["event_log_cleaned"], disc["case_features"], EVENTS_MODEL,
                          fit=False)
    qs = E.queries()
    want = qs["var_case_variants"](spark, SF001)
    cols = ["case_id", "variant", "variant_rank"]
    assert rows(disc["case_features"], cols) == rows(want, cols)
    b1 = rows(bott["bottleneck_summary"], ["activity", "n_occurrences"])
    b2 = rows(qs["btn_bottleneck"](spark, SF001), ["activity", "n_occurrences"])
    assert b1 == b2
    c1 = rows(bott["conformance"], ["case_id", "is_conformant", "deviation_types"])
    c2 = rows(qs["cnf_case_conformance"](spark, SF001), ["case_id", "is_conformant",
                                                          "deviation_types"])
    assert c1 == c2
    paths = write_outputs({"case_features": disc["case_features"],
                           "bottleneck_report": bott["bottleneck_report"]}, tmp_dir, "csv")
    back = spark.read.option("header", True).csv(paths["case_features"])
    assert back.count() == disc["case_features"].count()
    assert bott["bottleneck_report"].count() == 1
