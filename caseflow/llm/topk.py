"""Exact top-k by inner product: norm-bucketed retrieval with pruning.

Vectors are quantised to ``floor(scale * x)`` and sorted by length, longest
first; a block of candidates is cut into buckets of similar length.  For a
query with the k-th best score ``t`` so far and a bucket with the largest
length ``l``, a candidate must reach the cosine ``t / (|q| l)``: above 1 the
bucket is skipped; from ``COORDINATE_FROM`` on, only candidates whose largest
query coordinates lie in the range that this cosine allows are verified
(coordinate pruning); below, the prefix of candidates that are long enough
(length pruning).  What is left is verified by exact integer products.

Queries are a stated set, dealt against all rows block by block; a query's k
best of every block meet in a final ranking.

Defined results: vectors that are null, hold null or non-finite components or
have a null id take no part; rows with the query's id are its own and no
candidates; vectors of another dimension are not compared; ties go to the
smaller id; the pairs of rows that repeat a query's id are ranked together;
scores beyond 64 bits are cut to their range; an empty table or no query
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.vectors import blocks, cells, vector_rows

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
BUCKET = 1024
COORDINATE_FROM = 0.5
FOCUS = 3      # coordinates that are checked
SLACK = 1e-9   # rounding of cosines; widens every bound
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(m: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(m * scale), -2.0 ** 62, 2.0 ** 62).astype("<i8")


def products(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; in floating point while that is exact."""
    if exact:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    wide = q.astype(object) @ c.T.astype(object)
    return np.clip(wide, LOW, HIGH).astype(np.int64)


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.bound = np.full(n, -np.inf)  # k-th best score

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores[i], scores], np.r_[self.ids[i], ids]
        order = np.lexsort((ids, ~scores))[:self.k]
        self.scores[i], self.ids[i] = scores[order], ids[order]
        if len(order) == self.k:
            self.bound[i] = scores[order[-1]]


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Best:
    """The k best candidates (sorted by length, longest first) of each query."""
    best = Best(len(q), k)
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    exact = top < 2 ** 52
    q_len, c_len = (np.sqrt((x.astype(np.float64) ** 2).sum(1)) for x in (q, c))
    unit_q = q / np.maximum(q_len, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit_q), 1, kind="stable")[:, :FOCUS]
    for a in range(0, len(c), BUCKET):
        b_ids, b, b_len = c_ids[a:a + BUCKET], c[a:a + BUCKET], c_len[a:a + BUCKET]
        reach = q_len * b_len[0]
        cosine = np.where((reach > 0) & (best.bound > 0), best.bound / np.maximum(reach, 1e-300), -1.0)
        alive = np.flatnonzero(cosine <= 1 + SLACK)
        by_coordinate = alive[cosine[alive] >= COORDINATE_FROM]
        by_length = alive[cosine[alive] < COORDINATE_FROM]
        if len(by_length):
            need = np.where(best.bound[by_length] > 0,
                            best.bound[by_length] / np.maximum(q_len[by_length], 1e-300), 0) * (1 - SLACK)
            prefix = np.searchsorted(-b_len, -need, "right")
            n = int(prefix.max())
            scores = products(q[by_length], b[:n], exact)
            for r, i in enumerate(by_length):
                use = np.flatnonzero((scores[r, :prefix[r]] >= best.bound[i]) & (b_ids[:prefix[r]] != q_ids[i]))
                if len(use):
                    best.add(i, scores[r, use], b_ids[use])
        if len(by_coordinate):
            unit_b = b / np.maximum(b_len, 1e-300)[:, None]
            for i in by_coordinate:
                f = focus[i]
                mid = np.arccos(np.clip(unit_q[i, f], -1, 1))
                wide = np.arccos(min(1.0, cosine[i]))
                low = np.cos(np.minimum(np.pi, mid + wide)) - SLACK
                high = np.cos(np.maximum(0, mid - wide)) + SLACK
                use = np.flatnonzero(((unit_b[:, f] >= low) & (unit_b[:, f] <= high)).all(1)
                                     & (b_ids != q_ids[i]))
                if len(use):
                    scores = products(q[i:i + 1], b[use], exact)[0]
                    keep = scores >= best.bound[i]
                    best.add(i, scores[keep], b_ids[use][keep])
    return best


def top_k(df: DataFrame, is_query: str, k: int = 5, scale: float = 256.0,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row
    that ``is_query`` (an SQL condition) selects."""

    def turn(ids: np.ndarray, m: np.ndarray) -> dict:
        v = quantised(m, scale)
        return {"key": np.full(len(ids), m.shape[1]), "vec": v,
                "ord": -np.sqrt((v.astype(np.float64) ** 2).sum(1))}

    schema = "query_id long, vec_id long, score long"

    def work(left: dict | None, right: dict | None) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        if left is not None:
            (q_ids, q), (c_ids, c) = ((ids := np.frombuffer(x["ids"], "<i8"),
                                       np.frombuffer(x["vecs"], "<i8").reshape(len(ids), x["dim"]))
                                      for x in (left, right))
            best = search(q_ids, q, c_ids, c, k)
            n = [len(s) for s in best.ids]
            out = [np.repeat(q_ids, n), np.concatenate(best.ids), np.concatenate(best.scores)]
        return pa.table({"query_id": out[0], "vec_id": out[1], "score": out[2]})

    candidates = blocks(vector_rows(df, id_col, vec_col, turn), CANDIDATE_BLOCK)
    queries = blocks(vector_rows(df.where(is_query), id_col, vec_col, turn), QUERY_BLOCK)
    found = cells(queries, candidates, work, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
