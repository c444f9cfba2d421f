"""Sinks (SNK-1..3): parquet (default), CSV with header, XES; export text rules.

Writes are plain DataFrame writers: each task writes its own files, nothing
passes through the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.text import sanitize_text
from caseflow.schema import ACTIVITY, CASE, LIFECYCLE, RESOURCE, SEQ, SLICE, TS

CSV_TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list | None = None, sort_within: list | None = None) -> str:
    """SNK-1/SNK-2.  ``sort_within`` lays rows out per file (e.g. case, ts)
    without a global sort."""
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = (w.option("header", True).option("timestampNTZFormat", CSV_TS_FORMAT)
             .option("quote", '"').option("escape", '"').option("emptyValue", '""')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    w.format(fmt).save(path)
    return path


def write_event_log(log: DataFrame, path: str, fmt: str = "parquet") -> str:
    """The cleaned log, laid out by case and time inside each file (the
    internal ``ts_slice`` layout column is not written)."""
    return write_table(log.drop(SLICE), path, fmt, sort_within=[CASE, TS, SEQ])


def sanitize_for_export(df: DataFrame, ts_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """SNK-3: every string column -> CR/LF/TAB runs to one space and trimmed
    (NULL stays NULL); every timestamp -> text in ``ts_format``."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(sanitize_text(f.name).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(f.name, ts_format).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# columns that become attributes of the trace: key, column, kind
_TRACE_COLUMNS = (("LoanGoal", "loan_goal", "string"), ("ApplicationType", "application_type", "string"),
                  ("RequestedAmount", "requested_amount", "float"))
_XML_BAD = re.compile("[^\\t\\n\\r\\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _attr(kind: str, key: str, value: str) -> str:
    """One attribute element; line breaks and tabs as character references."""
    return f"<{kind} key={quoteattr(_XML_BAD.sub('\ufffd', key))} value={quoteattr(_XML_BAD.sub('\ufffd', value))}/>"


def _xes_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events sorted by case and time -> the lines of one XES document.  It
    opens and closes traces while rows pass and holds one batch at a time."""
    case, lines = None, ['<?xml version="1.0" encoding="UTF-8"?>', '<log xes.version="1.0">']
    started = False
    for batch in batches:
        rows = batch.to_pylist()
        started = started or bool(rows)
        for r in rows:
            if r["case"] != case:
                if case is not None:
                    lines.append("</trace>")
                case = r["case"]
                lines += ["<trace>", _attr("string", "concept:name", case)]
                lines += [_attr(kind, key, r[c]) for key, c, kind in _TRACE_COLUMNS if r.get(c) is not None]
                lines += [_attr("string", k.removeprefix("case:"), str(v)) for k, v in
                          json.loads(r["of_case"] or "{}").items() if k.startswith("case:") and v is not None]
            own = [("string", "concept:name", r["activity"]), ("string", "org:resource", r.get("resource")),
                   ("string", "lifecycle:transition", r.get("lifecycle")), ("date", "time:timestamp", r["time"])]
            more = json.loads(r["attributes"] or "{}")
            own += [("string", k, str(v)) for k, v in more.items() if not k.startswith("case:") and v is not None]
            lines.append("<event>" + "".join(_attr(*a) for a in own if a[2] is not None) + "</event>")
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        lines = []
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([*lines, "</trace>", "</log>"], pa.string())], names=["value"])


def write_xes(log: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write a canonical log as XES, one document a task.

    The cases are dealt by key and sorted by time, which spills, and a task
    writes the lines of its document while the sorted rows pass, so its memory
    does not depend on the length of a case.  Spark's text writer commits whole
    files: a task that is tried again leaves no half trace.
    """
    text = F.concat(F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    order = [c for c in (TS, SEQ, ACTIVITY) if c in log.columns]
    dealt = log.repartition(CASE).sortWithinPartitions(CASE, *order)
    # of a trace: the first value that is not null, over the same partitioning and order
    whole = Window.partitionBy(CASE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    extra = F.col("attributes") if "attributes" in log.columns else F.lit(None).cast("string")
    rows = dealt.select(
        F.col(CASE).alias("case"), F.col(ACTIVITY).alias("activity"), text.alias("time"),
        *[F.col(c).alias(n) for c, n in ((RESOURCE, "resource"), (LIFECYCLE, "lifecycle")) if c in log.columns],
        extra.alias("attributes"), F.first(extra).over(whole).alias("of_case"),
        *[F.first(F.col(c), ignorenulls=True).over(whole).cast("string").alias(c)
          for _, c, _ in _TRACE_COLUMNS if c in log.columns])
    rows.mapInArrow(_xes_lines, "value string").write.mode(mode).text(path)
    return path
