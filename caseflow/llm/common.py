"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.session import scratch_path

# Bytes of text that one vectorised step works on; bounds a worker's memory.
SLICE_BYTES = 4 << 20

# Empty what operators keep in a worker for its next task, by the operator's name.
KEPT: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read
    back: later steps neither recompute it nor depend on executor storage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so further
    columns of the input can have any name and reach no task."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batch: pa.RecordBatch, text: str = "text",
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``max_bytes`` of text (one row
    at least, so a very long text comes alone)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // max_bytes
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def texts(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The text column with null as the empty text."""
    return pc.fill_null(batch.column(text), "")


def give_back(keep: str = "") -> None:
    """Memory that this worker does not use goes back to the system: what other
    operators than ``keep`` have kept, and the free memory of Arrow and malloc."""
    for name, empty in KEPT.items():
        if name != keep:
            empty()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(run: Callable, keep: str = "") -> Callable:
    """``run`` of a ``mapInArrow`` that gives memory back before and after its
    task.  Workers outlive their tasks, and what stays in them adds up with the
    memory of the JVM."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(keep)
        try:
            yield from run(batches)
        finally:
            give_back(keep)

    return task


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array)
         else columns[f.name].cast(f.type) for f in schema], schema=schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
