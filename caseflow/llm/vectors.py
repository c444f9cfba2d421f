"""Blocks of vectors, and block against block.

Rows are sorted by a key and an order and cut into blocks of bounded size; for
every key, each block of queries meets each block of candidates in a group of
its own (a cell).  A cell holds one block of each side, so no task grows with
the data or with a hot key: more rows make more blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import written
from caseflow.session import shuffle_partitions

ROW = "key long, ord double, id long, dim int, vec binary"
BLOCK = "key long, part int, seq long, dim int, ids binary, vecs binary"


def valid_vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors (rows of one matrix per dimension) of a batch with the
    columns ``id`` and ``vec``; rows with a null id, a null vector, a null
    component or one that is not finite are left out."""
    lists = batch.column("vec")
    ok = batch.column("id").is_valid().to_numpy(zero_copy_only=False) & \
        lists.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    lists = lists.take(pa.array(rows))
    flat = pc.fill_null(pc.cast(lists.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = batch.column("id").take(pa.array(rows)).to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        own = np.flatnonzero(size == dim)
        m = flat[start[own][:, None] + np.arange(dim)].reshape(len(own), int(dim))
        fine = np.isfinite(m).all(1)
        yield ids[own][fine], m[fine]


def vector_rows(df: DataFrame, id_col: str, vec_col: str,
                turn: Callable[[np.ndarray, np.ndarray], dict]) -> DataFrame:
    """Rows of the ``ROW`` schema: ``turn(ids, matrix)`` gives the columns
    ``key``, ``ord``, ``vec`` (matrix to store) and, optionally, ``row`` (the
    row that each entry comes from; entries may be fewer or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                for ids, m in valid_vectors(batch.slice(a, 4096)):
                    got = turn(ids, m)
                    row = got.get("row", np.arange(len(ids)))
                    vec = np.ascontiguousarray(got["vec"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(got["key"], pa.int64()), pa.array(got["ord"], pa.float64()),
                         pa.array(ids[row]), pa.array(np.full(len(row), m.shape[1]), pa.int32()),
                         pa.array([v.tobytes() for v in vec], pa.binary())],
                        names=["key", "ord", "id", "dim", "vec"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                     F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).mapInArrow(run, ROW)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows of one key and dimension, in the order
    of ``ord`` and id, numbered by (part, seq) within the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, now = TaskContext.get().partitionId(), {}, [], None

        def out():
            key, dim = now
            seq[key] = seq.get(key, -1) + 1
            ids = np.array([i for i, _ in held], "<i8")
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([part], pa.int32()), pa.array([seq[key]], pa.int64()),
                 pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([b"".join(v for _, v in held)], pa.binary())],
                names=["key", "part", "seq", "dim", "ids", "vecs"])

        for batch in batches:
            for key, id_, dim, vec in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "dim", "vec"))):
                if held and (now != (key, dim) or len(held) == size):
                    yield out()
                    held = []
                now = key, dim
                held.append((id_, vec))
        if held:
            yield out()

    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "key", "dim", "ord", "id",
                                    F.monotonically_increasing_id())
    return written(dealt.sortWithinPartitions("key", "dim", "ord", "id").mapInArrow(run, BLOCK), "blocks")


def numbered(blocks_: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Blocks with ``n``, their number within the key, and the number of blocks
    of each key.  Ranges keep keys together, so the counts collected are at
    most one per key and one more per partition."""
    spark = blocks_.sparkSession
    total: dict[int, int] = {}
    base = []
    for key, part, n in sorted(blocks_.groupBy("key", "part").count().collect()):
        base.append((key, part, total.get(key, 0)))
        total[key] = total.get(key, 0) + n
    first = spark.createDataFrame(base or [(0, -1, 0)], "key long, part int, base long")
    return (blocks_.join(F.broadcast(first), ["key", "part"])
            .withColumn("n", F.col("base") + F.col("seq")).drop("part", "seq", "base")), total


def cells(queries: DataFrame, candidates: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(queries, candidates)`` (two rows of blocks as dicts) for each pair
    of blocks of one key; it returns the columns of ``schema``."""
    spark = queries.sparkSession
    q, n_q = numbered(queries)
    c, n_c = numbered(candidates)
    both = [(k, n_q[k], n_c[k]) for k in n_q if k in n_c]
    counts = F.broadcast(spark.createDataFrame(both or [(-1, 0, 0)], "key long, n_q long, n_c long"))
    cols = ["key", "dim", "ids", "vecs"]
    q = q.join(counts, "key").select(*cols, F.lit(True).alias("query"), F.col("n").alias("i"),
                                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_c") - 1)).alias("j"))
    c = c.join(counts, "key").select(*cols, F.lit(False).alias("query"),
                                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_q") - 1)).alias("i"),
                                     F.col("n").alias("j"))
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        left, right = ([r for r in rows if r["query"] is side] for side in (True, False))
        return work(left[0], right[0]) if left and right else work(None, None)

    return q.unionByName(c).groupBy("key", "i", "j").applyInArrow(run, schema)
