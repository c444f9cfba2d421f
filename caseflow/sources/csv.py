"""CSV inputs (SRC-2..4): the cleaned event log and the case table.

Schemas are declared (no inference pass over the data).  A missing path
fails at once with Spark's ``PATH_NOT_FOUND`` analysis error, wrapped in a
:class:`FileNotFoundError` that names the file and the step that makes it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.operators.clean import rename_to_canonical
from caseflow.schema import EVENT_LOG, conform

# One way to quote, for reading and writing: texts with line breaks, quotes and
# backslashes come back as they were.
CSV_TEXT = {"header": True, "multiLine": True, "quote": '"', "escape": '"',
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"

CASE_CSV = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("case_start", T.TimestampNTZType()),
    T.StructField("case_end", T.TimestampNTZType()),
    T.StructField("duration_hours", T.DoubleType()),
    T.StructField("duration_days", T.DoubleType()),
    T.StructField("n_events", T.LongType()),
    T.StructField("n_unique_activities", T.LongType()),
    T.StructField("n_resources", T.LongType()),
    T.StructField("last_activity", T.StringType()),
    T.StructField("loan_goal", T.StringType()),
    T.StructField("requested_amount", T.DoubleType()),
    T.StructField("application_type", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("sla_breach", T.IntegerType()),
    T.StructField("sla_days", T.IntegerType()),
    T.StructField("start_month", T.IntegerType()),
    T.StructField("start_quarter", T.IntegerType()),
    T.StructField("start_dow", T.StringType()),
    T.StructField("start_month_name", T.StringType()),
    T.StructField("duration_bucket", T.StringType()),
    T.StructField("has_rework", T.IntegerType()),
    T.StructField("rework_events", T.LongType()),
    T.StructField("variant", T.StringType()),
    T.StructField("variant_rank", T.LongType()),
    T.StructField("is_top3_variant", T.IntegerType()),
    T.StructField("is_top10_variant", T.IntegerType()),
])


DAMAGED = "damaged_row"


def _load(spark: SparkSession, path: str, schema: T.StructType, what: str,
          keep_damaged: bool = False) -> DataFrame:
    """Cells that cannot be read as their type are NULL (cleaning drops events
    without a time); ``keep_damaged`` adds the text of every row with such a
    cell or a wrong number of cells, so that none goes unnoticed."""
    if keep_damaged:
        schema = T.StructType([*schema.fields, T.StructField(DAMAGED, T.StringType())])
    try:
        df = (spark.read.options(**CSV_TEXT).option("timestampNTZFormat", TS_FORMAT)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", DAMAGED)
              .schema(schema).csv(path))
        df.schema  # noqa: B018  (forces path resolution)
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(
                f"{what} not found at {path}; run the discovery step first") from e
        raise


def _header(spark: SparkSession, path: str, what: str) -> list:
    """Column names from the header line (no pass over the data)."""
    try:
        return spark.read.options(**CSV_TEXT).csv(path).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"{what} not found at {path}; run the discovery step first") from e
        raise


def read_event_csv(spark: SparkSession, path: str, header_names: list | None = None,
                   keep_damaged: bool = False) -> DataFrame:
    """Event-log CSV with canonical or XES-style header names, in any column
    order: the header line is read first (no inference pass over the data)
    and the schema is declared by name.  Quoted texts may hold line breaks and
    quotes."""
    names = header_names or _header(spark, path, "event log")
    fields = {f.name: f.dataType for f in EVENT_LOG.fields}
    canon = {"case:concept:name": "case_id", "concept:name": "activity",
             "time:timestamp": "ts", "org:resource": "resource",
             "lifecycle:transition": "lifecycle", "case:LoanGoal": "loan_goal",
             "case:RequestedAmount": "requested_amount",
             "case:ApplicationType": "application_type"}
    schema = T.StructType([T.StructField(n, fields.get(canon.get(n, n), T.StringType()))
                           for n in names])
    df = _load(spark, path, schema, "event log", keep_damaged)
    return conform(rename_to_canonical(df))


def read_case_csv(spark: SparkSession, path: str, schema: T.StructType = CASE_CSV) -> DataFrame:
    """Case-table CSV: columns are found by their name in the header, in any
    order; unknown ones stay text, missing ones are NULL.  A file of the
    original tools may name the key ``case:concept:name``."""
    names = _header(spark, path, "case table")
    types = {f.name: f.dataType for f in schema.fields}
    df = _load(spark, path, T.StructType([
        T.StructField(n, types.get("case_id" if n == "case:concept:name" else n, T.StringType()))
        for n in names]), "case table")
    df = df.withColumnsRenamed({"case:concept:name": "case_id"})
    have = set(df.columns)
    return df.select(*[F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema.fields],
                     *[F.col(f"`{c}`") for c in df.columns if c not in types])
