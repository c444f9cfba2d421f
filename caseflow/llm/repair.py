"""Token-ID shards compressed by a Re-Pair grammar.

Documents are encoded in ascending order of their id; the ids of a shard (a
run of whole documents, ``SHARD_TOKENS`` ids or one longer document) are
compressed by pair replacement: the frequent adjacent pairs of symbols are
counted, each gets a nonterminal, its occurrences are replaced, and so on with
the new sequence until no pair occurs ``MIN_COUNT`` times.  A shard stores the rules, the
expansion length of every nonterminal and the expanded position of every
``STEP``-th symbol, so a range of ids is decoded without the rest.

Shard layout, little-endian: the header ``HEADER`` (magic, documents, rules,
first nonterminal, bytes per symbol, ids, symbols); the rules (two u4 each);
the expansion lengths (u4 each); the symbols (u2 or u4 each); the expanded
position (u8) of every ``STEP``-th symbol; the first id of each document (u8).

A data set is a Parquet table with one row per shard (part, shard, ids before
it in its part, ids, document ids, payload): Spark commits the files, so a
lost executor leaves no half-written shard, and any store Spark writes to will
do.  Parts are ranges of the document id and follow one another.

Defined results: null text is the empty text (the end id alone); null ids come
first; rows with one id are kept, in any order among them; an empty table gives
an empty data set; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import id_text, slices, texts
from caseflow.session import shuffle_partitions

SHARD_TOKENS = 1 << 20
STEP = 256
MIN_COUNT = 16  # a pair that occurs less often gets no rule
FALL = 16       # pairs within this factor of the most frequent one share a pass
SLOTS = 1 << 20  # hash slots for counting pairs
SPREAD, SPREAD_SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)
NO_PAIR = np.uint64(2**64 - 1)
HEADER = struct.Struct("<8sIIIIQQ")
MAGIC = b"RPSHARD1"


def _disjoint(at: np.ndarray, rank: np.ndarray, none: int) -> np.ndarray:
    """Which of the pairs at the places ``at`` (ascending) to replace, no two of
    them overlapping: first those that rank before both neighbours, then every
    second one of what is left."""
    next_ = np.diff(at) == 1
    left, right = np.full(len(rank), none), np.full(len(rank), none)
    left[1:][next_], right[:-1][next_] = rank[:-1][next_], rank[1:][next_]
    chosen = (rank < none) & (rank < left) & (rank < right)
    free = (rank < none) & ~chosen
    free[1:] &= ~(chosen[:-1] & next_)
    free[:-1] &= ~(chosen[1:] & next_)
    some = np.flatnonzero(free)
    if len(some):
        place = at[some]
        new = np.r_[True, np.diff(place) > 1]
        first = place[new][np.cumsum(new) - 1]
        chosen[some[(place - first) % 2 == 0]] = True
    return np.flatnonzero(chosen)


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, rules (pairs of symbols) and the first nonterminal."""
    first = int(ids.max()) + 1 if len(ids) else 0
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    slot_key, slot_rank = np.full(SLOTS, NO_PAIR), np.zeros(SLOTS, np.int32)
    slot_open = np.zeros(SLOTS, bool)
    limit, at = len(seq), None
    while len(seq) > 1:
        if at is None:
            pair = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
            slot = (pair * SPREAD >> SPREAD_SHIFT).view(np.int64)
            # a slot's count bounds the count of each of its pairs from above
            in_slot = np.bincount(slot, minlength=SLOTS)
            limit = max(MIN_COUNT, min(limit, int(in_slot.max())) // FALL)
            at = np.flatnonzero((in_slot >= limit)[slot])
            pair, slot = pair[at], slot[at]
        else:
            pair = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
            slot = (pair * SPREAD >> SPREAD_SHIFT).view(np.int64)
        ordered = np.sort(pair)
        run = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][:len(ordered)])
        count = np.diff(np.r_[run, len(ordered)])
        frequent = np.flatnonzero(count >= limit)
        frequent = frequent[np.argsort(-count[frequent], kind="stable")]
        keys = ordered[run[frequent]]
        own = (keys * SPREAD >> SPREAD_SHIFT).view(np.int64)[::-1]
        slot_key[own] = keys[::-1]  # of pairs in one slot the most frequent; others wait a pass
        slot_rank[own] = np.arange(len(keys))[::-1]
        rank = np.where(slot_key[slot] == pair, slot_rank[slot], len(keys))
        slot_key[own] = NO_PAIR
        chosen = _disjoint(at, rank, len(keys))
        where, rank_at = at[chosen], rank[chosen]
        used = np.bincount(rank_at, minlength=len(keys)) > 2
        if len(keys):
            where, rank_at = where[used[rank_at]], rank_at[used[rank_at]]
        if not len(where) and limit == MIN_COUNT:
            break
        name = np.cumsum(used) - 1 + first + len(rules)
        seq[where] = name[rank_at]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq = seq[keep]
        if limit > MIN_COUNT:
            at = None
        else:
            # from here on only pairs that were frequent, and those of a new
            # symbol, can be: every occurrence of either is among these places
            slot_open[own] = True
            open_ = np.zeros(len(keep), bool)
            open_[at[slot_open[slot]]] = True
            slot_open[own] = False
            open_ = open_[keep]
            made = where - np.arange(len(where))
            open_[made], open_[made[made > 0] - 1] = True, True
            at = np.flatnonzero(open_[:-1])
        rules = np.r_[rules, np.stack([keys[used] >> np.uint64(32), keys[used] & np.uint64(0xFFFFFFFF)],
                                      1).astype(np.uint32)]
    return seq, rules, first


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    out = np.ones(len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):  # a rule only uses earlier ones
        out[i] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def to_payload(ids: np.ndarray, doc_first: np.ndarray) -> bytes:
    seq, rules, first = compress(ids)
    lengths = expansion_lengths(rules, first)
    size = np.where(seq >= first, lengths[np.where(seq >= first, seq - first, 0)], 1) if len(rules) \
        else np.ones(len(seq), np.int64)
    at = (np.cumsum(size, dtype=np.uint64) - size.astype(np.uint64))[::STEP]
    width = 2 if first + len(rules) <= 1 << 16 else 4
    return b"".join([
        HEADER.pack(MAGIC, len(doc_first), len(rules), first, width, len(ids), len(seq)),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
        seq.astype(f"<u{width}").tobytes(), at.astype("<u8").tobytes(),
        doc_first.astype("<u8").tobytes()])


class Shard:
    """Reader of one payload."""

    def __init__(self, payload: bytes):
        magic, docs, rules, self.first, width, self.n_ids, symbols = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        self.symbols = take(f"<u{width}", symbols)
        self.steps = take("<u8", -(-symbols // STEP))
        self.doc_first = take("<u8", docs).astype(np.int64)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        seq = seq.astype(np.uint32)
        while True:
            deep = seq >= self.first
            if not len(self.rules) or not deep.any():
                return seq
            ends = np.cumsum(1 + deep)
            out = np.empty(ends[-1], np.uint32)
            out[ends - 1] = seq
            pairs = self.rules[seq[deep] - self.first]
            out[ends[deep] - 2], out[ends[deep] - 1] = pairs[:, 0], pairs[:, 1]
            seq = out

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``stop``; expands only the symbols that
        cover them (found by the stored positions)."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.steps, start, "right")) - 1
        b = int(np.searchsorted(self.steps, stop, "left"))
        skip = start - int(self.steps[a])
        return self._expand(self.symbols[a * STEP:b * STEP])[skip:skip + stop - start]

    def document(self, i: int) -> np.ndarray:
        ends = np.r_[self.doc_first[1:], self.n_ids]
        return self.ids(int(self.doc_first[i]), int(ends[i]))


SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()),
                    ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("payload", pa.binary())])


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the documents and write the data set to ``path``."""

    def run(batches):
        from caseflow.llm.encode import encoder

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        docs_, ids_, sizes_, held, before, shard = [], [], [], 0, 0, 0

        def flush():
            ids, sizes = np.concatenate(ids_), np.concatenate(sizes_)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()),
                pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([[x for d in docs_ for x in d.to_pylist()]], pa.list_(pa.int64())),
                pa.array([to_payload(ids, np.cumsum(sizes) - sizes)], pa.binary())], schema=SHARDS)

        for batch in batches:
            for rows in slices(batch):
                ids, sizes = enc.encode(texts(rows))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                docs_.append(rows.column("doc_id"))
                ids_.append(ids.astype(np.uint32))
                sizes_.append(sizes + 1)
                held += len(ids)
                if held >= SHARD_TOKENS:
                    yield flush()
                    before, shard = before + held, shard + 1
                    docs_, ids_, sizes_, held = [], [], [], 0
        if docs_:
            yield flush()

    keys = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    (id_text(docs, id_col, text_col)
     .repartitionByRange(shuffle_partitions(docs.sparkSession), *keys)
     .sortWithinPartitions("doc_id")
     .mapInArrow(run, "part int, shard int, before long, n_ids long, doc_ids array<long>, "
                      "payload binary")
     .write.option("compression", "zstd").parquet(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32
    of every document, decoded from the shards."""
    shards = spark.read.parquet(path)
    # one row per part, and there are as many parts as shuffle partitions
    sums = sorted(shards.groupBy("part").agg(F.sum("n_ids")).collect())
    base, total = {}, 0
    for part, n in sums:
        base[part] = total
        total += n

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("payload")[i].as_py())
                first = base[batch.column("part")[i].as_py()] + batch.column("before")[i].as_py()
                ids = shard.ids().astype("<u4")
                ends = np.r_[shard.doc_first[1:], shard.n_ids]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids")[i].values, pa.array(shard.doc_first + first),
                    pa.array(ends - shard.doc_first),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(shard.doc_first, ends)],
                             pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.drop("shard", "n_ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
