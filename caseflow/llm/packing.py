"""Sum-of-squares packing of documents into token sequences.

A document is its ids and one end id; only documents longer than a sequence
are cut, into whole sequences and a last piece.  Pieces are placed by the
sum-of-squares rule: with ``N(g)`` the number of open sequences that have
``g`` places left, a piece goes where the sum of all ``N(g)^2`` becomes
smallest (ties: the smallest gap that fits).  Long pieces are placed first;
what ends up in sequences with a gap is placed once more, see ``packed``.

Pieces of one length can be exchanged, so the rule only needs the number of
pieces of each length: at most ``capacity`` counters, whatever the size of the
corpus.  The counters are written in base ``BASE``: the highest digits form a
profile of at most ``PROFILE`` pieces that is packed once and used ``f`` times
(``f`` a power of ``BASE``), what remains forms the next profile, down to
``f = 1``, so every piece has a place.  The work on the driver is bounded by
``PROFILE`` placements per digit; all rows stay distributed: they are dealt by
ranges of (length, hash), so a length that holds a third of all rows is spread
over many tasks, and every task looks up the places of its own rows.

Defined results: null text is the empty text (one piece, the end id); a null
id is kept as null; repeated rows are packed once each; an empty table gives
no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import give_back, id_text, lean, record_batch, slices, texts, written
from caseflow.session import shuffle_partitions

SLICE = 1 << 20  # bytes of text in one vectorised step
PROFILE = 1 << 16
BASE = 4

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        from caseflow.llm.encode import encoder

        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                give_back(keep="encoder")  # or the library's free memory adds up within the task
                ids, sizes = enc.encode(texts(part))
                ends = np.cumsum(sizes)
                doc, piece, length, crc = [], [], [], []
                for i, (a, b) in enumerate(zip(ends - sizes, ends)):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for k in range(0, len(own), capacity):
                        x = own[k:k + capacity]
                        doc.append(i)
                        piece.append(k // capacity)
                        length.append(len(x))
                        crc.append(zlib.crc32(x.tobytes()))
                yield record_batch(PIECES, doc_id=part.column("doc_id").take(pa.array(doc, pa.int64())),
                                   piece=piece, start=np.array(piece, np.int64) * capacity,
                                   length=length, ids_crc32=crc)

    return id_text(docs, id_col, text_col).mapInArrow(
        lean(run, keep="encoder"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(pieces: list[int], capacity: int) -> list[list[int]]:
    """Place the pieces (lengths under ``capacity``, in this order) by the
    sum-of-squares rule; the pieces of every bin."""
    n_open = np.zeros(capacity + 1)
    n_open[0] = -0.5  # a filled bin counts nothing: 2 * N(0) + 1 = 0
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for s in pieces:
        from_, to = n_open[s:capacity], n_open[:capacity - s]
        change = np.where(from_ > 0, to - from_, np.inf)  # half of the change, less 1
        g = int(np.argmin(change))
        if 2 * change[g] + 2 <= 2 * n_open[capacity - s] + 1:
            gap = g + s
            b = by_gap[gap].pop()
            n_open[gap] -= 1
        else:  # a new bin
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        if gap > s:
            by_gap[gap - s].append(b)
            n_open[gap - s] += 1
    return bins


def best_fit(pieces: list[int], capacity: int) -> list[list[int]]:
    """Place every piece into the bin with the smallest gap that fits."""
    gaps: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for s in pieces:
        i = bisect.bisect_left(gaps, (s, -1))
        if i < len(gaps):
            gap, b = gaps.pop(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        if gap > s:
            bisect.insort(gaps, (gap - s, b))
    return bins


def packed(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of ``counts[s]`` pieces of each length ``s`` (``0 < s < capacity``).

    Bins that the rule leaves with a gap are emptied and their pieces placed
    again by the rule, as long as that needs fewer bins; a last attempt places
    them by best fit and is kept if it needs fewer still."""
    pieces = np.repeat(np.arange(len(counts)), counts)[::-1].tolist()
    done: list[list[int]] = []
    rule, last = sum_of_squares, len(pieces) + 1
    while pieces:
        bins = rule(pieces, capacity)
        if len(bins) < last:
            kept, last = bins, len(bins)
        elif rule is best_fit:
            return done + kept
        else:
            rule = best_fit
            continue
        if rule is best_fit:
            return done + kept
        done += [b for b in kept if sum(b) == capacity]
        kept = [b for b in kept if sum(b) < capacity]
        last = len(kept)
        pieces = sorted((s for b in kept for s in b), reverse=True)
    return done


def packing_plan(counts: np.ndarray, capacity: int) -> list[dict]:
    """Levels of the plan, see the module text: factor, first sequence, first
    rank of each length, and the places of each length."""
    rest, levels, first_seq = counts.astype(np.int64).copy(), [], 0
    first_rank = np.zeros(capacity + 1, np.int64)
    factor = 1
    while (rest // factor).sum() > PROFILE:
        factor *= BASE
    while factor:
        own = rest // factor
        rest -= own * factor
        if own.any():
            bins = packed(own, capacity)
            length = np.array([s for b in bins for s in b], np.int64)
            place = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            offset = np.concatenate([np.cumsum([0, *b[:-1]]) for b in bins])
            made, order = len(bins), np.argsort(length, kind="stable")
            levels.append({"factor": factor, "first_seq": first_seq, "made": made,
                           "first_rank": first_rank.copy(), "own": own,
                           "at": np.r_[0, np.cumsum(own)], "place": place[order],
                           "offset": offset[order]})
            first_rank += own * factor
            first_seq += made * factor
        factor //= BASE
    return levels


def find_places(levels: list[dict], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the ``rank``-th piece of each length."""
    seq = np.full(len(length), -1, np.int64)
    offset = np.zeros(len(length), np.int64)
    for lv in levels:
        r = rank - lv["first_rank"][length]
        own = lv["own"][length]
        rows = np.flatnonzero((r >= 0) & (r < own * lv["factor"]))
        copy, slot = r[rows] // own[rows], r[rows] % own[rows]
        at = lv["at"][length[rows]] + slot
        seq[rows] = lv["first_seq"] + copy * lv["made"] + lv["place"][at]
        offset[rows] = lv["offset"][at]
    return seq, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every
    piece; the offsets of a sequence are gapless from 0."""
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    dealt = pieces.repartitionByRange(
        shuffle_partitions(docs.sparkSession), "length",
        F.xxhash64("doc_id", "piece", "ids_crc32"), F.monotonically_increasing_id())
    dealt = written(dealt.sortWithinPartitions("length")
                    .withColumn("part", F.spark_partition_id())
                    .withColumn("row", F.monotonically_increasing_id()), "dealt")
    # contiguous ranges of the length: at most capacity + partitions rows
    runs = sorted(dealt.groupBy("length", "part").agg(F.count(F.lit(1)), F.min("row")).collect())
    counts = np.zeros(capacity + 1, np.int64)
    before = {}
    for length, part, n, row in runs:
        before[part, length] = int(counts[length]) - row
        counts[length] += n
    full = int(counts[capacity])
    counts[capacity] = 0
    levels = packing_plan(counts, capacity)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, part, row = (batch.column(c).to_numpy() for c in ("length", "part", "row"))
            key = part.astype(np.int64) * (capacity + 1) + length
            keys, at = np.unique(key, return_inverse=True)
            rank = row + np.array([before[k // (capacity + 1), k % (capacity + 1)] for k in keys])[at]
            seq, offset = find_places(levels, length, rank)
            seq = np.where(length == capacity, rank, seq + full)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in PIECES] + [pa.array(seq), pa.array(offset)],
                names=[f.name for f in PIECES] + ["sequence_id", "offset"])

    return dealt.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, "
                                 "ids_crc32 long, sequence_id long, offset long")
