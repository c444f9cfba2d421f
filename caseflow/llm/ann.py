"""Approximate nearest neighbours with learned partitions.

On a bounded sample (``SAMPLE`` rows by the hash of their id) the graph of
nearest neighbours is cut into ``2 ** DEPTH`` parts of equal size (fewer, if parts would have
under ``PART_SAMPLE`` rows of the sample): each half
is split at the median of a smooth vector on its part of the graph (power
steps of the neighbour averages), then pairs of vertices change sides as long
as that cuts fewer edges.  A small network with one hidden layer learns, for a
vector, how its neighbours spread over the parts.

Every row of the table is put into its most probable part.  A query goes to
its most probable parts, as many as let the sample's own queries find
``TARGET`` of their true neighbours, and is ranked against all rows of those
parts by the exact distance in double precision.  A part of any size is dealt
in blocks, so copies or a dense region make more tasks, not larger ones.

Defined results: vectors that are null, zero, hold null or non-finite
components or have a null id take no part; so do vectors of a dimension other
than the most frequent one of the sample; rows with the query's id are its own
and no candidates; ties go to the smaller id; the pairs of rows that repeat a
query's id are ranked together; a sample of under ``2 * PART_SAMPLE`` rows makes one part; an
empty table or no query gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import quoted
from caseflow.llm.vectors import blocks, cells, vector_rows

SAMPLE = 8000
PART_SAMPLE = 100  # sample rows that a part has at least
DEPTH = 5
NEIGHBOURS = 10
HIDDEN = 96
TARGET = 0.94
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row (brute force in blocks)."""
    sq = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        d = sq - 2 * (x[a:a + 1024] @ x.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a:a + 1024] = np.argpartition(d, k - 1, 1)[:, :k]
    return out


def halves(rows: np.ndarray, edges: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A balanced cut of the graph ``edges`` (pairs of positions in ``rows``)."""
    n = len(rows)
    a, b = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    v = rng.normal(size=n)
    for _ in range(60):  # second eigenvector of the averaging walk
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * np.bincount(a, v[b], n) / degree
        v /= max(np.abs(v).max(), 1e-12)
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2:]] = True
    for _ in range(20):  # swap the pairs that gain
        other = np.bincount(a, (side[a] != side[b]).astype(float), n)
        gain = 2 * other - np.bincount(a, minlength=n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swaps = int(((gain[left[:m]] + gain[right[:m]]) > 0).sum()) // 2
        if not swaps:
            break
        new = side.copy()
        new[left[:swaps]], new[right[:swaps]] = True, False
        if (new[a] != new[b]).sum() >= (side[a] != side[b]).sum():
            break
        side = new
    return side


def balanced_parts(near: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each row of the sample."""
    part = np.zeros(len(near), np.int64)
    edges = np.stack([np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()], 1)
    for _ in range(depth):
        new = part.copy()
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            at = np.full(len(near), -1)
            at[rows] = np.arange(len(rows))
            own = at[edges]
            new[rows] = 2 * p + halves(rows, own[(own >= 0).all(1)], rng)
        part = new
    return part


class Router:
    """One hidden layer; the probability of each part."""

    def __init__(self, dim: int, parts: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w1 = rng.normal(0, 1 / np.sqrt(dim), (dim, HIDDEN))
        self.b1 = np.zeros(HIDDEN)
        self.w2 = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts))
        self.b2 = np.zeros(parts)
        self.scale = 1.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 25, batch: int = 128,
            rate: float = 0.004, seed: int = 3) -> "Router":
        self.scale = 4 / max(float(np.sqrt((x * x).sum(1)).mean()), 1e-12)
        rng = np.random.default_rng(seed)
        names = ("w1", "b1", "w2", "b2")
        m, v = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                xb, tb = x[order[a:a + batch]] * self.scale, target[order[a:a + batch]]
                h = np.maximum(xb @ self.w1 + self.b1, 0)
                z = h @ self.w2 + self.b2
                z = np.exp(z - z.max(1, keepdims=True))
                d = (z / z.sum(1, keepdims=True) - tb) / len(xb)
                back = (d @ self.w2.T) * (h > 0)
                step += 1
                for k, g in zip(names, (xb.T @ back, back.sum(0), h.T @ d, d.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9 ** step))
                            / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8))
        return self


def learn(x: np.ndarray, depth: int = DEPTH, target: float = TARGET) -> tuple[Router | None, int]:
    """Router and number of parts to probe, from the sample."""
    while depth and len(x) >> depth < PART_SAMPLE:
        depth -= 1
    if not depth:
        return None, 1
    near = nearest(x, NEIGHBOURS)
    part = balanced_parts(near, depth, np.random.default_rng(5))
    spread = np.zeros((len(x), 1 << depth))
    np.add.at(spread, (np.repeat(np.arange(len(x)), NEIGHBOURS), part[near].ravel()), 1 / (NEIGHBOURS + 1))
    spread[np.arange(len(x)), part] += 1 / (NEIGHBOURS + 1)
    # routers of two halves of the sample, each judged on the other half,
    # give the number of probes; the last one learns from all
    held = np.arange(len(x)) % 2 == 0
    need = []
    for own in (held, ~held):
        p = Router(x.shape[1], 1 << depth).fit(x[own], spread[own])(x)
        home = p.argmax(1)
        order = np.argsort(-p, 1, kind="stable").argsort(1)
        need.append(np.take_along_axis(order, home[near], 1)[~own].ravel())
    rank = np.sort(np.concatenate(need))
    probes = int(rank[min(len(rank) - 1, int(np.ceil(target * len(rank))))]) + 1
    return Router(x.shape[1], 1 << depth).fit(x, spread), probes


def sample(df: DataFrame, id_col: str, vec_col: str) -> np.ndarray:
    """At most ``SAMPLE`` vectors, those with the smallest hash of their id.
    A share of the hashes, sized by the number of rows, is sent to the driver;
    it holds a quarter more than wanted."""
    share = min(1.0, 1.25 * SAMPLE / max(df.count(), 1))
    some = df.where(F.pmod(F.xxhash64(F.col(quoted(id_col)).cast("long")), F.lit(1_000_000)) < share * 1_000_000)
    rows = vector_rows(some, id_col, vec_col, lambda ids, m: {
        "key": np.zeros(len(ids), np.int64), "ord": np.zeros(len(ids)), "vec": m.astype("<f8")})
    got = rows.orderBy(F.pmod(F.xxhash64("id"), F.lit(1_000_000)), F.xxhash64("id"), "id", "vec").limit(SAMPLE).select("dim", "vec").collect()
    if not got:
        return np.zeros((0, 0))
    dims = [r.dim for r in got]
    dim = max(sorted(set(dims)), key=dims.count)
    x = np.frombuffer(b"".join(bytes(r.vec) for r in got if r.dim == dim), "<f8").reshape(-1, dim)
    return x[(x != 0).any(1)]


def rerank(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple]:
    """(query, neighbour, distance) of the k nearest candidates of each query.
    Matrix products find who can be among them; their distances are computed
    from the differences."""
    out = []
    sq = (c * c).sum(1)
    for a in range(0, len(q), 64):
        part = q[a:a + 64]
        rough = sq + (part * part).sum(1)[:, None] - 2 * (part @ c.T)
        slack = 1e-9 * (sq.max() + (part * part).sum(1))
        for i, row in enumerate(rough):
            row[c_ids == q_ids[a + i]] = np.inf
            limit = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            use = np.flatnonzero((row <= limit + 2 * slack[i]) & (row < np.inf))
            d = np.sqrt(((c[use] - part[i]) ** 2).sum(1))
            best = np.lexsort((c_ids[use], d))[:k]
            out += [(int(q_ids[a + i]), int(c_ids[use[j]]), float(d[j])) for j in best]
    return out


def search(df: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest
    rows found for each row that ``is_query`` (an SQL condition) selects."""
    x = sample(df, id_col, vec_col)
    router, probes = learn(x) if len(x) else (None, 1)
    dim = x.shape[1] if len(x) else -1

    def routed(n: int):
        def turn(ids: np.ndarray, m: np.ndarray) -> dict:
            rows = np.flatnonzero((m != 0).any(1)) if m.shape[1] == dim else np.zeros(0, np.int64)
            if router is None or not len(rows):
                parts = np.zeros((len(rows), 1), np.int64)
            else:
                parts = np.argsort(-router(m[rows]), 1, kind="stable")[:, :n]
            row = np.repeat(rows, parts.shape[1])
            return {"key": parts.ravel(), "ord": np.zeros(len(row)), "vec": m[row].astype("<f8"), "row": row}
        return turn

    def work(left: dict | None, right: dict | None) -> pa.Table:
        found: list[tuple] = []
        if left is not None:
            (q_ids, q), (c_ids, c) = ((ids := np.frombuffer(r["ids"], "<i8"),
                                       np.frombuffer(r["vecs"], "<f8").reshape(len(ids), r["dim"]))
                                      for r in (left, right))
            found = rerank(q_ids, q, c_ids, c, k)
        q_, c_, d_ = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q_, pa.int64()), "vec_id": pa.array(c_, pa.int64()),
                         "score": pa.array(d_, pa.float64())})

    index = blocks(vector_rows(df, id_col, vec_col, routed(1)), CANDIDATE_BLOCK)
    queries = blocks(vector_rows(df.where(is_query), id_col, vec_col, routed(probes)), QUERY_BLOCK)
    found = cells(queries, index, work, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
