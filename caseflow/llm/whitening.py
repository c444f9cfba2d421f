"""Whitening of vectors with components found by FEAST.

The covariance of the vectors is summed in Spark, centred by the exact mean; it
is a matrix of the dimension, however many rows there are.  Its largest
eigenpairs come from contour integration: inertia counts (numbers of negative
pivots of a shifted symmetric factorisation) cut the upper end of the spectrum
into intervals of a few eigenvalues; for each, quadrature of complex shifted
solves on a circle projects a block of vectors onto the interval's eigenspace,
Rayleigh-Ritz extracts the pairs, and the count says whether one is missing.

A component ``c`` of a vector becomes the integer ``floor(64 c) + 1000000``;
values beyond 2^61 saturate.

Defined results: rows whose vector is null, empty or holds null or non-finite
components drop out; a null id stays; repeated rows count each.  Vectors of
another dimension are another fit list.  Components without variance (equal
rows, dependent dimensions; below 1e-13 of the trace for each dimension) have
no whitened value and are not returned.  An empty table gives no rows.
``deviation`` is exact, as a decimal of 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import quoted

SCALE, SHIFT, LARGEST = 64.0, 1_000_000, float(1 << 61)
COMPONENTS = 32
PER_INTERVAL, NODES, ROUNDS = 8, 8, 30
EXACT = 1 << 62


# ---- spectrum --------------------------------------------------------------------

def inertia(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric matrix below ``shift``: negative pivots of
    a factorisation with symmetric pivoting by blocks of one or two rows."""
    m = a - shift * np.eye(len(a))
    below, alpha = 0, (1 + np.sqrt(17)) / 8
    while len(m):
        diagonal, off = np.abs(np.diag(m)), np.abs(np.triu(m, 1))
        r = int(diagonal.argmax())
        if diagonal[r] >= alpha * off.max(initial=0.0):
            if diagonal[r] == 0.0:
                break  # the rest is zero: eigenvalues equal to the shift
            keep = np.arange(len(m)) != r
            pivot, row = m[r, r], m[r, keep]
            below += pivot < 0
            m = m[np.ix_(keep, keep)] - np.outer(row, row) / pivot
        else:
            r, s = np.unravel_index(off.argmax(), off.shape)
            keep = np.setdiff1d(np.arange(len(m)), [r, s])
            below += 1  # such a block has one negative and one positive eigenvalue
            block, rows = m[np.ix_([r, s], [r, s])], m[np.ix_([r, s], keep)]
            m = m[np.ix_(keep, keep)] - rows.T @ np.linalg.solve(block, rows)
    return below


def intervals(a: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals [low, high) with their numbers of eigenvalues, which together
    hold the ``wanted`` largest, highest first; found by bisection."""
    radius = np.abs(a).sum(1) - np.abs(np.diag(a))
    low, high = float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())
    least = 1e-10 * max(abs(low), abs(high), 1e-300)  # narrower ones hold one cluster
    low, high = low - least, high + least
    open_, done, have = [(low, high, 0, len(a))], [], 0
    while open_ and have < wanted:
        lo, hi, below_lo, below_hi = open_.pop()
        n = below_hi - below_lo
        if n == 0:
            continue
        if n > 1 and (n > PER_INTERVAL or n > wanted - have) and hi - lo > least:
            mid = (lo + hi) / 2
            below = int(min(max(inertia(a, mid), below_lo), below_hi))
            open_ += [(lo, mid, below_lo, below), (mid, hi, below, below_hi)]
            continue
        done.append((lo, hi, n))
        have += n
    return done


def feast(a: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of the symmetric matrix with eigenvalues in
    [low, high).  A block that does not converge grows; one of the whole
    dimension is exact."""
    size = len(a)
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 + at))  # upper half; the lower one is its conjugate
    shifted = [np.linalg.inv((centre + radius * t) * np.eye(size) - a) for t in turn]
    scale = max(np.abs(a).max(), 1e-300)
    block = min(size, count + max(4, count // 2))
    rng = np.random.default_rng(count)
    y = rng.normal(size=(size, block))
    for step in range(ROUNDS):
        if block < size:
            y = sum(w / 2 * radius * (t * (g @ y)).real for w, t, g in zip(weight, turn, shifted))
        q, _ = np.linalg.qr(y)
        values, vectors = np.linalg.eigh(q.T @ a @ q)
        y = q @ vectors
        inside = np.flatnonzero((values >= low) & (values < high))
        rest = np.abs(a @ y[:, inside] - y[:, inside] * values[inside]).max(initial=0.0)
        if block == size or (len(inside) == count and rest <= 2e-15 * size * scale):
            break
        if step % 10 == 9 or len(inside) > count:
            block = min(size, 2 * block)
            y = np.c_[y, rng.normal(size=(size, block - y.shape[1]))]
    if len(inside) != count:  # ties at an end of the interval: the nearest to its middle
        inside = np.argsort(np.abs(values - centre), kind="stable")[:count]
    return values[inside], y[:, inside]


def largest(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors."""
    wanted = min(wanted, len(a))
    if not wanted or not np.abs(a).max():
        return np.zeros(wanted), np.eye(len(a))[:, :wanted]
    found = [feast(a, *part) for part in intervals(a, wanted)]
    # all intervals together once more, so that vectors across their borders are orthogonal
    q, _ = np.linalg.qr(np.concatenate([v for _, v in found], 1))
    values, vectors = np.linalg.eigh(q.T @ a @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    basis = q @ vectors[:, order]
    sign = np.sign(basis[np.abs(basis).argmax(0), np.arange(len(order))])
    return values[order], basis * np.where(sign == 0, 1, sign)


# ---- rows ------------------------------------------------------------------------

@dataclass
class Basis:
    """One fit list: its rows, exact sums, components and figures."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n for s in self.sums], float) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        d = x - whole
        most = int(np.abs(d).max(initial=0)) + 1
        if x.shape[1] * (self.n * most) ** 2 < EXACT:
            return ((self.n * d - rest) ** 2).sum(1).tolist()
        return ((self.n * d.astype(object) - rest.astype(object)) ** 2).sum(1).tolist()


def integer_vectors(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the batch that hold a vector, and their integers, a dimension
    at a time."""
    rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    lists = lists.take(pa.array(rows))
    flat = pc.fill_null(pc.cast(lists.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    for dim in np.unique(size[size > 0]):
        own = np.flatnonzero(size == dim)
        m = flat[start[own][:, None] + np.arange(dim)]
        fine = np.isfinite(m).all(1)
        with np.errstate(over="ignore"):  # beyond the largest double it saturates as well
            x = np.clip(np.floor(SCALE * m[fine]), -LARGEST, LARGEST).astype(np.int64) + SHIFT
        yield rows[own[fine]], x


def _vectors(df: DataFrame, vec_col: str) -> DataFrame:
    return df.select(F.col(quoted(vec_col)).cast("array<double>").alias("vec"))


def _summed(df: DataFrame, vec_col: str, add: Callable[[np.ndarray], np.ndarray]) -> dict[int, tuple[int, np.ndarray]]:
    """Rows and summed ``add(x)`` (a matrix) of each dimension.  A task adds up
    its rows; the matrices' rows of all tasks are added in Spark, in the order
    of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                for _, x in integer_vectors(batch.slice(a, 4096).column(0)):
                    dim = x.shape[1]
                    total[dim] = total.get(dim, 0) + add(x)
                    rows[dim] = rows.get(dim, 0) + len(x)
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(m), dim), pa.int32()), pa.array(np.arange(len(m)), pa.int32()),
                 pa.array(np.full(len(m), TaskContext.get().partitionId()), pa.int32()),
                 pa.array(np.full(len(m), rows[dim])), pa.array(m.tolist(), pa.list_(pa.float64()))],
                names=["dim", "i", "task", "n", "row"])

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by("task")
        m = np.sum(np.array(t.column("row").to_pylist()), 0)
        return pa.table({"dim": t.column("dim")[:1], "i": t.column("i")[:1],
                         "n": pa.array([int(np.sum(t.column("n").to_numpy()))]), "row": [m.tolist()]},
                        schema=pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("n", pa.int64()),
                                          ("row", pa.list_(pa.float64()))]))

    got = (_vectors(df, vec_col).mapInArrow(run, "dim int, i int, task int, n long, row array<double>")
           .groupBy("dim", "i").applyInArrow(together, "dim int, i int, n long, row array<double>").collect())
    out: dict[int, tuple[int, np.ndarray]] = {}
    for dim in {r.dim for r in got}:
        own = sorted((r for r in got if r.dim == dim), key=lambda r: r.i)
        out[dim] = own[0].n, np.array([r.row for r in own])
    return out


def _exact_sums(df: DataFrame, vec_col: str) -> dict[int, tuple[int, list[int]]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                for _, x in integer_vectors(batch.slice(a, 4096).column(0)):
                    if not len(x):
                        continue
                    small = int(np.abs(x).max()) * len(x) < EXACT
                    s = x.sum(0).tolist() if small else x.astype(object).sum(0).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x.shape[1]] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()),
                         pa.array([len(x)] * len(s), pa.int64()), pa.array(s, pa.decimal128(38, 0))],
                        names=["dim", "i", "n", "s"])

    got = (_vectors(df, vec_col).mapInArrow(run, "dim int, i int, n long, s decimal(38,0)")
           .groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    return {dim: (next(r.n for r in got if r.dim == dim),
                  [int(r.s) for r in sorted((r for r in got if r.dim == dim), key=lambda r: r.i)])
            for dim in {r.dim for r in got}}


def fit(df: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Basis]:
    """The basis of each dimension that occurs (usually one): three scans, for
    the mean, the covariance and the covariance of the whitened rows."""
    sums = _exact_sums(df, vec_col)
    centre = {d: Basis(n, s, np.zeros(0), np.zeros((d, 0)), 0.0) for d, (n, s) in sums.items()}

    def squares(x: np.ndarray) -> np.ndarray:
        c = centre[x.shape[1]].centred(x)
        return c.T @ c

    bases: dict[int, Basis] = {}
    for dim, (n, total) in _summed(df, vec_col, squares).items():
        v = (total + total.T) / 2 / n
        trace = float(np.trace(v))
        values, vectors = largest(v, components)
        keep = values > 1e-13 * dim * trace
        bases[dim] = Basis(n, sums[dim][1], values[keep], vectors[:, keep], trace)

    def whitened_squares(x: np.ndarray) -> np.ndarray:
        # the last row has the sums: the covariance is centred by their mean, which is nearly 0
        w = bases[x.shape[1]].project(x)
        return np.vstack([w.T @ w, w.sum(0)])

    for dim, (n, total) in _summed(df, vec_col, whitened_squares).items():
        mean = total[-1] / n
        cov = total[:-1] / n - np.outer(mean, mean)
        bases[dim].identity_error = float(np.abs(cov - np.eye(len(mean))).max(initial=0.0))
    return bases


def whiten(df: DataFrame, bases: dict[int, Basis], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``n``, ``deviation``, ``identity_error`` and ``components``
    (``whitened`` and ``explained``, largest first) of each row with a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                for rows, x in integer_vectors(part.column("vec")):
                    b = bases.get(x.shape[1])
                    if b is None or not len(rows):
                        continue
                    w, k = b.project(x), len(b.values)
                    pairs = pa.StructArray.from_arrays(
                        [pa.array(w.ravel()), pa.array(np.tile(b.values / b.trace, len(rows)) if k else np.zeros(0))],
                        names=["whitened", "explained"])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), b.n)),
                         pa.array(b.deviation(x), pa.decimal128(38, 0)), pa.array(np.full(len(rows), b.identity_error)),
                         pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pairs)],
                        names=["vec_id", "n", "deviation", "identity_error", "components"])

    out = T.StructType([
        T.StructField("vec_id", df.schema[id_col].dataType), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("identity_error", T.DoubleType()),
        T.StructField("components", T.ArrayType(T.StructType([
            T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())])))])
    return df.select(F.col(quoted(id_col)).alias("vec_id"),
                     F.col(quoted(vec_col)).cast("array<double>").alias("vec")).mapInArrow(run, out)
