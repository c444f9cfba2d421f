"""Language identification by a byte convolutional network.

A text is its UTF-8 bytes, cut into windows of ``WINDOW`` bytes (the last one
filled up with zeros).  Filters of two, three and four bytes over learned byte
vectors, the maximum of each filter over the window and a softmax layer give
the scores of a window; the scores of a document are their mean, weighted by
the windows' bytes, so every byte of the text counts.

The network is trained in numpy on the driver with a bounded sample of the
labelled rows (about ``SAMPLE_PER_LANG`` documents for each value and
``WINDOWS_PER_DOC`` windows each, chosen by a hash of the id); everything else
runs over all rows.

Defined results: null text or one without a letter gives ``und`` and score 0,
as does a table without any labelled row; a null id is not learned from and
not held out; repeated rows get equal answers; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import lean, slices, texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
BYTE_DIM = 8
SAMPLE_PER_LANG = 600
WINDOWS_PER_DOC = 4
UNKNOWN = "und"


def windows(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts, and of every window: first byte, bytes, text."""
    data = data.cast(pa.large_string())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = offsets[:-1][doc] + k * WINDOW
    return raw, first, np.minimum(WINDOW, offsets[1:][doc] - first), doc


def window_bytes(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.arange(WINDOW)
    inside = at < size[:, None]
    return np.where(inside, raw[np.where(inside, first[:, None] + at, 0)], 0).astype(np.uint8)


class ByteNet:
    """The network; ``fit`` learns it, ``scores`` applies it to windows."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"byte": rng.normal(0, 0.5, (256, BYTE_DIM))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * BYTE_DIM), (w, BYTE_DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes))
        self.p["bias"] = np.zeros(classes)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.tables: list | None = None

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Filter maxima and their places (training only)."""
        out, places = [], []
        for w in WIDTHS:
            tables = np.einsum("be,wef->wbf", self.p["byte"], self.p[f"w{w}"])
            n = x.shape[1] - w + 1
            conv = sum(tables[k][x[:, k:k + n]] for k in range(w)) + self.p[f"b{w}"]
            at = conv.argmax(1)
            places.append(at)
            out.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
        return np.concatenate(out, 1), places

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 64,
            rate: float = 0.006, seed: int = 7) -> "ByteNet":
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a:a + batch]
                xb = x[rows]
                raw, places = self._pooled(xb)
                pooled = np.maximum(raw, 0)
                z = pooled @ self.p["out"] + self.p["bias"]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(rows)), y[rows]] -= 1
                z /= len(rows)
                grad = {"out": pooled.T @ z, "bias": z.sum(0), "byte": np.zeros_like(self.p["byte"])}
                back = (z @ self.p["out"].T) * (raw > 0)
                for i, w in enumerate(WIDTHS):
                    d = back[:, i * FILTERS:(i + 1) * FILTERS]
                    seen = xb[np.arange(len(rows))[:, None, None], places[i][..., None] + np.arange(w)]
                    vec = self.p["byte"][seen]                       # rows, filters, w, dim
                    grad[f"w{w}"] = np.einsum("bf,bfwe->wef", d, vec)
                    grad[f"b{w}"] = d.sum(0)
                    np.add.at(grad["byte"], seen, np.einsum("bf,wef->bfwe", d, self.p[f"w{w}"]))
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Class scores (before the softmax) of windows.  The filters of all
        widths are looked up by byte pairs: three lookups for each byte."""
        if self.tables is None:
            t = {w: np.einsum("be,wef->wbf", self.p["byte"], self.p[f"w{w}"]) for w in WIDTHS}
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
            self.tables = [np.concatenate([pair(t[w][0], t[w][1]) + self.p[f"b{w}"] for w in WIDTHS], 1),
                           t[3][2], pair(t[4][2], t[4][3])]
        first, third, tail = self.tables
        out = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for a in range(0, len(x), 256):
            xb = x[a:a + 256].astype(np.int64)
            pairs = xb[:, :-1] << 8 | xb[:, 1:]
            conv = first[pairs]
            conv[:, :-1, FILTERS:2 * FILTERS] += third[xb[:, 2:]]
            conv[:, -1:, FILTERS:] = -np.inf  # only two bytes are left there
            conv[:, -2:, 2 * FILTERS:] = -np.inf
            conv[:, :-2, 2 * FILTERS:] += tail[pairs[:, 2:]]
            out[a:a + 256] = conv.max(1)
        return np.maximum(out, 0) @ self.p["out"] + self.p["bias"]


def document_scores(net: ByteNet, data: pa.Array) -> np.ndarray:
    """Softmax of the mean window scores of each text."""
    raw, first, size, doc = windows(data)
    sums = np.zeros((len(data), net.p["bias"].size))
    weight = np.bincount(doc, size, minlength=len(data))
    for a in range(0, len(first), 4096):
        s = net.scores(window_bytes(raw, first[a:a + 4096], size[a:a + 4096]))
        np.add.at(sums, doc[a:a + 4096], s * size[a:a + 4096, None])
    z = sums / np.maximum(weight, 1)[:, None]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _has_letter(data: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(data, r"\p{L}").to_numpy(zero_copy_only=False)


def learn(docs: DataFrame, learn_from: Column, text_col: str = "text", lang_col: str = "lang",
          key: str = "doc_id") -> tuple[list[str], ByteNet | None]:
    """Languages and network from the rows that ``learn_from`` selects."""
    rows = docs.where(learn_from).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(F.col(f"`{key}`")).alias("h")).where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], None
    share = F.coalesce(*[F.when(F.col("lang") == c, F.lit(min(1.0, SAMPLE_PER_LANG / n)))
                         for c, n in counts.items()])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data = texts(part)
                raw, first, size, doc = windows(data)
                n = np.bincount(doc, minlength=len(data))
                k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                step = np.maximum(1, -(-n // WINDOWS_PER_DOC))[doc]
                keep = np.flatnonzero((k % step == 0) & _has_letter(data)[doc])
                x = window_bytes(raw, first[keep], size[keep])
                of = pa.array(doc[keep], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(of), part.column("h").take(of), pa.array(k[keep]),
                     pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "h", "k", "x"])

    got = (rows.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)
           .mapInArrow(lean(pick), "lang string, h long, k long, x binary").orderBy("h", "k", "lang", "x").collect())
    if not got:
        return [], None
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.uint8).reshape(-1, WINDOW)
    y = np.array([langs.index(r.lang) for r in got])
    return langs, ByteNet(len(langs)).fit(x, y)


def identify(docs: DataFrame, langs: list[str], net: ByteNet | None, text_col: str = "text",
             pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the answer with its probability, which
    replace columns of these names."""
    docs = docs.drop(pred_col, score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                data = texts(part, text_col)
                pred = np.full(len(data), UNKNOWN, object)
                score = np.zeros(len(data))
                known = np.flatnonzero(_has_letter(data))
                if net is not None and len(known):
                    p = document_scores(net, data.take(pa.array(known)))
                    best = p.argmax(1)
                    pred[known] = np.array(langs, object)[best]
                    score[known] = p[np.arange(len(known)), best]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(pred, pa.string()), pa.array(score)],
                    names=[*part.schema.names, pred_col, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()),
                           T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(lean(run), schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows kept for judging: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 4 == 2, F.lit(False))


def label_rows(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 4 != 2, F.lit(False))
