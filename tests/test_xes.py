"""XES at event grain: any cutting of the file gives the same log."""

from __future__ import annotations

import glob
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F
from test_sources import XES

from caseflow.operators import clean as cl
from caseflow.sources import sinks, xes

ODD = """<?xml version="1.0" encoding="UTF-8"?>
<log>
 <global scope="event"><string key="concept:name" value="none"/></global>
 <trace></trace>
 <trace><string key="concept:name" value="first &amp; &quot;one&quot;"/><int key="more" value="5"/>
  <event/>
  <event><string value="b &lt;c&gt;" key='concept:name'/><date key="time:timestamp" value="2020-01-01T00:00:00Z"/>
   <string key="list"><string key="concept:name" value="nested"/></string></event>
 </trace><trace><string key="concept:name" value="zwei ä"/><event><string key="concept:name" value="x"/></event></trace>
 <trace><string key="concept:name" value="empty"/></trace>
</log>
"""


def rows(df):
    return sorted((str(sorted(r.trace_attrs.items())), r.event_pos, str(sorted(r.event_attrs.items(), key=str)))
                  for r in df.collect())


@pytest.fixture()
def split_size(spark):
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)),
                     spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("text", [XES, ODD])
def test_borders_anywhere(spark, tmp_dir, split_size, text):
    """Splits of a few bytes: borders fall inside events, headers and marks."""
    path = os.path.join(tmp_dir, "log.xes")
    with open(path, "w") as f:
        f.write(text)
    want = None
    for n in (1 << 20, 97, 31):
        split_size(n)
        got = rows(xes.read_xes_raw(spark, path))
        want = want or got
        assert got == want
    by = ElementTree.fromstring(text)
    assert len(want) == len(by.findall("trace/event"))


def test_odd_documents(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log.xes")
    with open(path, "w") as f:
        f.write(ODD)
    got = xes.read_xes(spark, path).orderBy("case_id", "event_seq").collect()
    assert [(r.case_id, r.activity, r.event_seq) for r in got] == [
        ('first & "one"', None, 0), ('first & "one"', "b <c>", 1), ("zwei ä", "x", 0)]
    one = xes.read_xes(spark, path).where("activity = 'b <c>'").select(
        xes.attribute("case:more").alias("more"), "ts").first()
    assert one.more == "5" and str(one.ts) == "2020-01-01 00:00:00"


def test_one_large_trace_in_several_tasks(spark, tmp_dir, split_size):
    """One trace of 30,000 events: every split has its share, positions go on."""
    n = 30_000
    path = os.path.join(tmp_dir, "big.xes")
    with open(path, "w") as f:
        f.write('<log><trace><string key="concept:name" value="huge"/>')
        for i in range(n):
            f.write(f'<event><string key="concept:name" value="a{i % 7}"/><int key="i" value="{i}"/></event>\n')
        f.write("</trace></log>")
    split_size(200_000)
    raw = xes.read_xes_raw(spark, path)
    got = raw.select(F.col("trace_attrs")["concept:name"].alias("c"), "event_pos",
                     F.col("event_attrs")["i"].cast("long").alias("i"))
    assert got.where("c = 'huge' and event_pos = i").count() == n == raw.count()
    text = spark.read.option("lineSep", "<event").text(path)
    per = text.groupBy(F.spark_partition_id()).count().collect()
    assert len(per) > 8 and max(r[1] for r in per) < n / 4


def test_written_documents_are_well_formed_and_read_back(spark, tmp_dir):
    cases = [("c\n1", "2024-01-01 00:00:00", 'A "x" <&>', None, None, 3), ("c\n1", "2024-01-01 00:00:00", "B", "tab\there", 7.5, 1),
             ("c2", "2024-01-03 00:00:00", "ä😀", "r", None, 2)]
    log = spark.createDataFrame(cases, "case_id string, t string, activity string, resource string, requested_amount double,"
                                " event_seq long").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    log = log.withColumn("attributes", F.lit('{"case:kind":"k1","note":"n\\n2"}'))
    path = sinks.write_xes(log, os.path.join(tmp_dir, "out"))
    names = []
    for part in glob.glob(os.path.join(path, "part-*")):
        for trace in ElementTree.parse(part).getroot().findall("trace"):
            names += [e.get("value") for e in trace.findall("string") if e.get("key") == "concept:name"]
    assert sorted(names) == ["c\n1", "c2"]
    got = {(r.case_id, r.activity): r for r in xes.read_xes(spark, path).collect()}
    assert set(got) == {(c[0], c[2]) for c in cases}
    assert got["c\n1", "B"].event_seq == 0 and got["c\n1", 'A "x" <&>'].event_seq == 1
    assert got["c\n1", "B"].resource == "tab\there" and got["c\n1", 'A "x" <&>'].requested_amount == 7.5
    assert got["c2", "ä😀"].requested_amount is None
    one = xes.read_xes(spark, path).where("case_id = 'c2'").select(
        xes.attribute("case:kind").alias("a"), xes.attribute("note").alias("b")).first()
    assert (one.a, one.b) == ("k1", "n\n2")


def test_case_of_a_million_events_is_written_as_it_passes(spark, tmp_dir):
    """The lines of a task come from one batch at a time, whatever the case."""
    n = 1_000_000
    log = spark.range(n).select(
        F.lit("one").alias("case_id"), F.concat(F.lit("a"), F.col("id") % 5).alias("activity"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_seq"))
    path = sinks.write_xes(log, os.path.join(tmp_dir, "out"))
    lines = spark.read.text(path)
    assert lines.where("value like '<event>%'").count() == n
    assert lines.where("value = '</trace>'").count() == 1
    back = xes.read_xes(spark, path).agg(F.count("ts"), F.max("event_seq"), F.countDistinct("event_seq")).first()
    assert tuple(back) == (n, n - 1, n)


def test_empty_log(spark, tmp_dir):
    log = spark.createDataFrame([], "case_id string, activity string, ts timestamp_ntz, event_seq long")
    path = sinks.write_xes(log, os.path.join(tmp_dir, "out"))
    assert cl.clean(xes.read_xes(spark, path)).count() == 0
