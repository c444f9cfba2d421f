"""Sources and sinks: XES (with offsets and a missing attribute), CSV, errors."""

from __future__ import annotations

import os

import pytest
from golden import golden_log
from pyspark.sql import functions as F

from caseflow.operators import clean as cl
from caseflow.sources import csv as csv_src
from caseflow.sources import adapters, sinks, xes

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0">
 <trace>
  <string key="concept:name" value="T1"/>
  <string key="LoanGoal" value="Car   loan"/>
  <float key="RequestedAmount" value="5000.0"/>
  <string key="ApplicationType" value="New credit"/>
  <event>
   <string key="concept:name" value="A_Create Application"/>
   <string key="org:resource" value="User_1"/>
   <string key="lifecycle:transition" value="complete"/>
   <date key="time:timestamp" value="2016-01-01T10:00:00.000+01:00"/>
  </event>
  <event>
   <string key="concept:name" value="A_Submitted"/>
   <date key="time:timestamp" value="2016-01-01T10:30:00.000+01:00"/>
  </event>
 </trace>
 <trace>
  <string key="concept:name" value="T2"/>
  <event>
   <string key="concept:name" value="W_Call after offers"/>
   <date key="time:timestamp" value="2016-01-02T00:00:00.000Z"/>
  </event>
 </trace>
</log>
"""


def test_read_xes_fixture(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log.xes")
    with open(path, "w") as f:
        f.write(XES)
    log = xes.read_xes(spark, path).orderBy("case_id", "event_seq").collect()
    assert [(r["case_id"], r["activity"], str(r["ts"])) for r in log] == [
        ("T1", "A_Create Application", "2016-01-01 09:00:00"),
        ("T1", "A_Submitted", "2016-01-01 09:30:00"),
        ("T2", "W_Call after offers", "2016-01-02 00:00:00"),
    ]
    assert log[0]["resource"] == "User_1" and log[1]["resource"] is None
    assert log[0]["requested_amount"] == 5000.0 and log[2]["loan_goal"] is None
    assert log[0]["application_type"] == "New credit"
    sq = cl.squeeze_loan_goal(xes.read_xes(spark, path)).first()
    assert sq["loan_goal"] == "Car loan"


def test_xes_roundtrip(spark, tmp_dir):
    log = golden_log(spark)
    path = sinks.write_xes(log, os.path.join(tmp_dir, "out.xes"))
    back = cl.clean(xes.read_xes(spark, path))
    a = sorted((r["case_id"], r["activity"], str(r["ts"]), r["resource"]) for r in log.collect())
    b = sorted((r["case_id"], r["activity"], str(r["ts"]), r["resource"]) for r in back.collect())
    assert a == b


def test_csv_roundtrip_and_missing(spark, tmp_dir):
    log = golden_log(spark)
    path = sinks.write_event_log(log, os.path.join(tmp_dir, "ev"), "csv")
    back = csv_src.read_event_csv(spark, path)
    assert back.count() == log.count()
    assert dict(back.dtypes)["ts"] == "timestamp_ntz"
    with pytest.raises(FileNotFoundError):
        csv_src.read_event_csv(spark, os.path.join(tmp_dir, "nope"))


def test_standardise_case_column(spark):
    df = spark.createDataFrame([("x", "a")], "`Case Concept Name` string, act string")
    assert "case:concept:name" in cl.standardise_case_column(df).columns
    two = spark.createDataFrame([("x", "y")], "`case_concept_name` string, `CaseConceptName` string")
    with pytest.raises(ValueError):
        cl.standardise_case_column(two)


def test_sanitize(spark):
    df = spark.createDataFrame([("a\r\nb\t", None), ("x\t\ty  z", "k")], "s string, t string")
    rows = sinks.sanitize_for_export(df).collect()
    assert rows[0]["s"] == "a b" and rows[0]["t"] is None
    assert rows[1]["s"] == "x y  z"   # only CR/LF/TAB runs collapse


def test_reference_style_csv(spark, tmp_dir):
    """XES-style header names in another order, pandas-style timestamps."""
    path = os.path.join(tmp_dir, "ref.csv")
    with open(path, "w") as f:
        f.write("org:resource,concept:name,time:timestamp,case:concept:name,case:RequestedAmount\n")
        f.write("User_1,A_Create Application,2016-01-01 09:51:15.304000,Application_1,20000.0\n")
        f.write("User_2,A_Submitted,2016-01-01 09:51:15,Application_1,20000.0\n")
        f.write(",W_Call,not a date,Application_2,\n")
    log = csv_src.read_event_csv(spark, path)
    got = sorted((r["case_id"], r["activity"], str(r["ts"]), r["resource"],
                  r["requested_amount"]) for r in log.collect())
    assert got[0] == ("Application_1", "A_Create Application", "2016-01-01 09:51:15.304000",
                      "User_1", 20000.0)
    assert got[1][2] == "2016-01-01 09:51:15"
    assert cl.clean(log).count() == 2      # the unparsable time drops


def test_xes_keeps_all_attributes_in_time_order(spark, tmp_dir):
    text = """<?xml version="1.0"?><log>
<trace><string key="concept:name" value="c1"/><string key="Channel" value="web"/>
 <event><string key="concept:name" value="late"/><date key="time:timestamp" value="2024-01-02T10:00:00+00:00"/>
  <string key="note" value="x &amp; y"/><int key="cost" value="7"/></event>
 <event><string key="concept:name" value="early"/><date key="time:timestamp" value="2024-01-01T10:00:00+00:00"/></event>
</trace></log>"""
    path = os.path.join(tmp_dir, "extra.xes")
    with open(path, "w") as f:
        f.write(text)
    log = xes.read_xes(spark, path)
    got = {r.activity: (r.channel, r.note, r.cost) for r in log.select(
        "activity", xes.attribute("case:Channel").alias("channel"), xes.attribute("note").alias("note"),
        xes.attribute("cost").alias("cost")).collect()}
    assert got == {"late": ("web", "x & y", "7"), "early": ("web", None, None)}
    out = sinks.write_xes(cl.clean(log).withColumn("event_seq", F.lit(None).cast("long")), os.path.join(tmp_dir, "b.xes"))
    back = xes.read_xes(spark, out).orderBy("event_seq")
    assert [r.activity for r in back.collect()] == ["early", "late"]
    assert {r.n for r in back.select(xes.attribute("note").alias("n")).collect()} == {None, "x & y"}


def test_event_csv_keeps_line_breaks_and_quotes(spark, tmp_dir):
    odd = 'a "quoted" text,\nwith a line break \\ and a backslash'
    rows = [("c1", "x", "2024-01-01 10:00:00", odd, 1), ("c1", "y", "2024-01-01 11:00:00", None, 2)]
    log = spark.createDataFrame(rows, "case_id string, activity string, ts string, resource string, event_seq long")
    log = log.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    path = sinks.write_event_log(log, os.path.join(tmp_dir, "odd"), "csv")
    back = csv_src.read_event_csv(spark, path)
    assert sorted((r.activity, r.resource, r.event_seq) for r in back.collect()) == [("x", odd, 1), ("y", None, 2)]


def test_case_csv_is_read_by_name(spark, tmp_dir):
    df = spark.createDataFrame([("a → b", "c1", 3, "2024-01-01 10:00:00")], "variant string, case_id string, n_events long, case_start string")
    path = sinks.write_table(df, os.path.join(tmp_dir, "cases"), "csv")
    r = csv_src.read_case_csv(spark, path).first()
    assert (r.case_id, r.variant, r.n_events, r.outcome) == ("c1", "a → b", 3, None)
    assert str(r.case_start) == "2024-01-01 10:00:00"


def test_weeks_of_two_years_are_two_cases(spark):
    ev = spark.sql("""select 1L as event_id, timestamp_ntz'2023-01-03 10:00:00' as ts, 5L as user_id, 'view' as event_type,
                      1.0d as value, '{}' as props union all
                      select 2L, timestamp_ntz'2024-01-03 10:00:00', 5L, 'view', 1.0d, '{}'""")
    assert adapters.events_user_week(ev).select("case_id").distinct().count() == 2


def test_damaged_rows_can_be_kept(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad.csv")
    with open(path, "w") as f:
        f.write("case_id,activity,ts\nc1,x,2024-01-01 10:00:00\nc2,y,no time\nc3\n")
    log = csv_src.read_event_csv(spark, path, keep_damaged=True)
    assert {r.case_id: r.damaged_row for r in log.collect()} == {"c1": None, "c2": "c2,y,no time", "c3": "c3"}
    assert cl.clean(csv_src.read_event_csv(spark, path)).count() == 1


def test_events_of_an_xes_file_are_parsed_once(spark, tmp_dir, capsys):
    path = os.path.join(tmp_dir, "once.xes")
    with open(path, "w") as f:
        f.write('<log><trace><string key="concept:name" value="c"/><event><string key="concept:name" value="a"/>'
                '<date key="time:timestamp" value="2020-01-01T00:00:00Z"/></event><event/></trace></log>')
    back = cl.clean(xes.read_xes(spark, path))
    back.explain()
    assert "from_xml" not in capsys.readouterr().out  # every filter and column had parsed again
    assert [r.activity for r in back.collect()] == ["a"]
    assert [r.event_pos for r in xes.read_xes_raw(spark, path).orderBy("event_pos").collect()] == [0, 1]
