"""Document pipeline: language, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.common import columns_of, free_name, table, written
from caseflow.llm.jaccard import jaccard_join
from caseflow.llm.langid import UNKNOWN, identify, label_rows, learn
from caseflow.llm.packing import pack
from caseflow.llm.queries import SEQUENCE, word_tokenizer
from caseflow.llm.secret_scan import redact

# A language answer below this probability is little more than a guess.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told: a text with letters and a clear answer.
    Null and empty texts go; without any labelled row no language is known and
    nothing is rejected but texts without a letter."""
    langs, net = learn(docs, label_rows())
    pred, score = free_name(docs, "_pred"), free_name(docs, "_score")
    told = identify(docs, langs, net, pred_col=pred, score_col=score)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return told.where((F.col(pred) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*columns_of(docs))


def numbered(spark: SparkSession, docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number of each row that every scan gives again, however
    it is split: the number of the file and the place in it.  Only where
    ``docs`` is not exactly the rows of its Parquet files, the rows are written
    with their numbers."""
    try:
        of = docs.metadataColumn("_metadata")
        file, path = free_name(docs, "_file"), free_name(docs, "_path")
        names = written(docs.select(of["file_path"].alias(path)).distinct().select(
            path, F.row_number().over(Window.orderBy(path)).cast("long").alias(file)), "files")
        rows = docs.withColumn(row, of["row_index"]).withColumn(path, of["file_path"]).join(
            F.broadcast(names), path).select(*columns_of(docs), (F.col(file) * (1 << 40) + F.col(row)).alias(row))
        n, most = rows.groupBy(row).count().agg(F.sum("count"), F.max("count")).first()
        if most == 1 and n == spark.read.parquet(*docs.inputFiles()).count():
            return rows
    except AnalysisException:  # not from Parquet files
        pass
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (also of repeated rows); rows
    without words stay.  Rows are told apart by their place in the input."""
    row = free_name(docs, "_row")
    rows = numbered(spark, docs, row)
    told = jaccard_join(rows, id_col=row)
    gone = written(told.where("component_id <> doc_id").select(F.col("doc_id").alias(row)), "near-copies")
    return rows.join(gone, row, "left_anti").select(*columns_of(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced; ``n_chars`` counts the new text."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                                 .otherwise(F.length("text").cast("long")))
    return clean.select(*columns_of(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    return pack(docs, word_tokenizer(), SEQUENCE, end_id=0)


STAGES = [
    ("language id", known_language),
    ("n-gram jaccard join", one_of_each_group),
    ("secret scan", without_secrets),
    ("best-fit packing", packed),
]

#: The network and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
