"""XES event logs at event grain (SRC-1).

The file is cut at ``<event`` by Spark's text source, so one event is one
record, and a file -- also a single trace of any size -- is read by as many
tasks as it has splits, in any file system that Spark reads.  Each task goes
through its blocks once: it sees where traces begin, numbers the events of
each and gives them the attributes of the trace.  Events before the first trace
of a block belong to a trace that began in an earlier block of the file; one
row a block says what to add for them.

Events are parsed by Spark's XML functions with a declared schema.  Trace
attributes are repeated on each event under ``case:<key>``, as the usual
XES-to-table conversion does; they must stand before the events of the trace,
as the standard has it.  Time values with an offset are converted to UTC and
the zone dropped.  ``<event`` and ``<trace`` inside comments are not looked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.operators.util import materialised
from caseflow.schema import conform

ATTR_KINDS = ["string", "date", "float", "int", "boolean", "id"]

_KV = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()),
                                T.StructField("_value", T.StringType())]))
EVENT_SCHEMA = T.StructType([T.StructField(k, _KV) for k in ATTR_KINDS])

# One row an event, and one row a block (``event`` null): the trace that the
# block ends in (null: none began in it) and how many of its events it holds.
_RECORDS = "file string, block long, trace long, pos long, attrs map<string,string>, event string"
_BATCH = 4096


def _epoch_ntz() -> F.Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _attr_map(struct_col) -> F.Column:
    """key -> value text over every typed attribute list of an element."""
    parts = [F.coalesce(struct_col[k], F.array().cast(_KV)) for k in ATTR_KINDS]
    kv = F.concat(*parts)
    return F.map_from_entries(F.transform(kv, lambda e: F.struct(e["_key"], e["_value"])))


def parse_xes_time(text) -> F.Column:
    """ISO-8601 text -> naive UTC TIMESTAMP_NTZ; unparsable -> NULL.

    The instant is taken as microseconds since the epoch and added to the
    naive epoch, so an offset is honoured whatever the session zone (text
    without an offset is read in the session zone, UTC in caseflow)."""
    ltz = F.try_to_timestamp(text)
    return F.timestamp_add("MICROSECOND", F.unix_micros(ltz), _epoch_ntz())


def _trace_attrs(head: str) -> list[tuple[str, str]]:
    """Attributes of a trace from the text after ``<trace``."""
    try:
        root = ElementTree.fromstring(f"<trace{head}</trace>")
    except ElementTree.ParseError:
        return []
    found = {e.get("key"): e.get("value") for kind in ATTR_KINDS for e in root.findall(kind) if e.get("key")}
    return list(found.items())


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``value``, ``file``, ``block`` in the order of the file -> ``_RECORDS``.
    The first record of a file is what stands before its first event."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("trace", pa.int64()), ("pos", pa.int64()),
                        ("attrs", pa.map_(pa.string(), pa.string())), ("event", pa.string())])
    out: list[tuple] = []
    now, trace, pos, attrs = None, 0, 0, None

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for rows in batches:
        for value, file, block in zip(*(rows.column(c).to_pylist() for c in ("value", "file", "block"))):
            if (file, block) != now:
                if now:
                    out.append((*now, trace, pos, attrs, None))
                preface = block == 0
                now, trace, pos, attrs = (file, block), 0, 0, None
            else:
                preface = False
            tail = value
            if not preface:
                tag, _, rest = value.partition(">")
                if tag.endswith("/"):  # an event without attributes
                    body, tail = "", rest
                else:
                    body, _, tail = rest.partition("</event>")
                out.append((*now, trace, pos, attrs, f"<event>{body}</event>"))
                pos += 1
            at = tail.rfind("<trace")
            if at >= 0:
                trace, pos, attrs = trace + 1, 0, _trace_attrs(tail[at + 6:])
            if len(out) >= _BATCH:
                yield batch()
                out.clear()
    if now:
        out.append((*now, trace, pos, attrs, None))
    if out:
        yield batch()


def read_xes_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every event with two maps: ``trace_attrs`` and ``event_attrs``.  The
    records are written once below the checkpoint folder: the blocks' rows and
    the events' rows must come from one and the same cutting of the files.
    Events are parsed before that, so no later filter or column parses again."""
    text = spark.read.option("lineSep", "<event").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    event = F.from_xml("event", EVENT_SCHEMA, {"attributePrefix": "_"})
    parsed = text.mapInArrow(_records, _RECORDS).withColumn("_ev", event)
    records = materialised(parsed.select(
        "file", "block", "trace", "pos", "attrs",
        F.when(F.col("event").isNotNull(), _attr_map(F.col("_ev"))).alias("event_attrs")), "xes-records")
    # what a block's first events carry on: attributes and events of the trace so far
    blocks = records.where("event_attrs is null").select("file", "block", "pos", "attrs")
    upto = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("_g", F.count("attrs").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("file", "_g").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("_pos", F.sum("pos").over(within)).withColumn(
        "_attrs", F.first("attrs", ignorenulls=True).over(within))
    carried = blocks.select("file", "block", F.lag("_pos").over(upto).alias("_pos"), F.lag("_attrs").over(upto).alias("_attrs"))
    events = records.where("event_attrs is not null").join(carried, ["file", "block"], "left")
    open_ = F.col("trace") == 0
    none = F.create_map().cast("map<string,string>")
    return events.select(
        F.coalesce(F.when(open_, F.col("_attrs")).otherwise(F.col("attrs")), none).alias("trace_attrs"),
        (F.col("pos") + F.when(open_, F.coalesce("_pos", F.lit(0))).otherwise(0)).alias("event_pos"),
        "event_attrs")


# Attributes that have a column of their own.
_TRACE_NAMED = ["concept:name", "LoanGoal", "RequestedAmount", "ApplicationType"]
_EVENT_NAMED = ["concept:name", "time:timestamp", "org:resource", "lifecycle:transition"]


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """XES file(s) -> canonical event log (not yet cleaned).  All attributes
    without a column of their own are kept in ``attributes``, a JSON object
    (trace attributes under ``case:<key>``; NULL if there are none); use
    :func:`attribute` to read one.  Analyses that do not use it never build it."""
    raw = read_xes_raw(spark, path)
    t, e = F.col("trace_attrs"), F.col("event_attrs")
    df = raw.select(
        t["concept:name"].alias("case_id"),
        e["concept:name"].alias("activity"),
        parse_xes_time(e["time:timestamp"]).alias("ts"),
        e["org:resource"].alias("resource"),
        e["lifecycle:transition"].alias("lifecycle"),
        t["LoanGoal"].alias("loan_goal"),
        t["RequestedAmount"].try_cast("double").alias("requested_amount"),
        t["ApplicationType"].alias("application_type"),
        F.col("event_pos").cast("long").alias("event_seq"),
        _others(t, e).alias("attributes"))
    return conform(df)


def _others(trace: F.Column, event: F.Column) -> F.Column:
    rest = F.map_concat(
        F.transform_keys(F.map_filter(trace, lambda k, v: ~k.isin(_TRACE_NAMED)),
                         lambda k, v: F.concat(F.lit("case:"), k)),
        F.map_filter(event, lambda k, v: ~k.isin(_EVENT_NAMED)))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def attribute(key: str, column: str = "attributes") -> F.Column:
    """One further attribute, as text."""
    return F.from_json(F.col(column), "map<string,string>")[key]
