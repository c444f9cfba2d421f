"""Command line: run discovery and bottleneck jobs and write their tables.

  spark-submit -m caseflow.plans.run --xes /data/log.xes --out /data/results
  python -m caseflow.plans.run --events /root/testdata/sf0.01 --out /tmp/x --no-ml

Inputs: an XES file/folder (``--xes``), an event CSV (``--csv``), a canonical
parquet log (``--parquet``) or the driver ``events`` table seen as user-weeks
(``--events <dir>``, with its process model).
"""

from __future__ import annotations

import argparse

from caseflow.model import EVENTS_MODEL, REFERENCE_MODEL
from caseflow.plans.pipelines import run_bottleneck, run_discovery, write_outputs
from caseflow.session import get_session
from caseflow.sources import adapters, xes
from caseflow.sources import csv as csv_src


def main(argv=None) -> dict:
    ap = argparse.ArgumentParser(prog="caseflow")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--xes")
    src.add_argument("--csv")
    src.add_argument("--parquet")
    src.add_argument("--events")
    ap.add_argument("--out", required=True)
    ap.add_argument("--fmt", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--master", default=None)
    ap.add_argument("--no-ml", action="store_true")
    ap.add_argument("--completed-only", action="store_true")
    ap.add_argument("--select-by", default="test_auc", choices=["test_auc", "cv_auc"])
    a = ap.parse_args(argv)

    spark = get_session(a.master)
    model = REFERENCE_MODEL
    if a.xes:
        raw = xes.read_xes(spark, a.xes)
    elif a.csv:
        raw = csv_src.read_event_csv(spark, a.csv)
    elif a.parquet:
        raw = spark.read.parquet(a.parquet)
    else:
        raw = adapters.main_log(spark, a.events)
        model = EVENTS_MODEL
    if a.completed_only:
        model = model.with_(completed_only=True)

    disc = run_discovery(raw, model)
    paths = write_outputs(disc, a.out, a.fmt)
    bott = run_bottleneck(disc["event_log_cleaned"], disc["case_features"], model,
                          fit=not a.no_ml, select_by=a.select_by)
    paths.update(write_outputs(bott, a.out, a.fmt))
    return paths


if __name__ == "__main__":
    for k, v in main().items():
        print(f"{k}\t{v}")
