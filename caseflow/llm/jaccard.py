"""Exact Jaccard join of documents on word shingles, as a metric-space join.

The Jaccard distance is a metric, so what is known about distances to pivots
decides most pairs without looking at them.  With radius ``r = 1 - similarity``
the join runs in these steps.

1. Equal shingle sets become one object, named by a 64-bit hash of the set.
2. First regions: the pivots are the sets of one shingle.  A document is
   nearest to the pivots of its own shingles, and under a common order of all
   shingles it can lie within ``r`` of another document only if both are in
   the region of one of their first ``n - ceil(s n) + 1`` shingles; it is
   replicated into these regions.  The order is by estimated frequency, then by
   hash: tasks count the shingles of all documents, and the logarithms of the
   sums go into a table of ``SLOTS`` bytes (shared slots cost order, never a
   pair), so a document's first shingles are its rare ones and regions stay
   small at every size of the data.  In a region, sizes and places in the order
   bound the overlap of a pair.
   Regions with the same smallest member, by a hash of the members, become one
   region, under ``MERGES`` hashes in turn: nearly equal regions (all those of
   a family of copies) fall together, members never become more.
3. A region in which at most ``SMALL / 2`` pairs a member are not yet connected
   (so any region of at most ``SMALL`` members) is joined pair by pair, unless it
   is dense; after the first round up to ``LATER`` times as many, since several
   rounds of pivots cost about as much.  From then on the ``BITS`` bits of two sets
   must allow the pair as well (parities of their shingles, which bound the
   difference), each member's nearest candidates come first, and pairs that are
   connected by then are not compared.  The others get documents as pivots (in the first round the one
   with the most first regions, which is in the middle of a family, then that of
   each of 4, 16, ... hash classes), and the
   distance of every member to them is computed, unless the sizes alone put
   it beyond ``2r``.  Members that cannot be similar to any other member by
   size and place leave first.  Members within ``r`` of a pivot (its core) are
   linked with it, so pairs inside a core need no more looking at.  By the
   triangle inequality a member of the core can only be linked to documents in
   the window ``r < d <= 2r`` around its pivot, and only members with
   ``d >= m - r`` where ``m`` is the smallest distance in the window.  So the
   region falls into a region for each pivot (its core, cut in this way, and
   its window; none if the window is empty) and one region of the documents
   outside all cores; pivots leave.  These regions join in the same way.  A
   region whose members are already connected is done.
4. Links make components; every row gets the smallest id that it reaches.

Regions are rows, not groups in one task: pivots are found by partial
aggregates, distances in blocks of bounded size, to which a set goes once for
all its pairs.  After
``ROUNDS`` rounds what is left is joined pair by pair, so the result is whole.

Defined results: null, empty and blank texts have no shingles, are linked with
nothing and are their own component; a null id takes part in links but names
no component (rows that reach no other id get a null); repeated rows are equal
sets; an empty table gives no rows; further columns are ignored.  Shingles and
sets are compared by 64-bit hashes: about one false pair among 5e9 documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import id_text, lean, slices, texts, written
from caseflow.llm.components import components
from caseflow.llm.shingles import set_id, shingle_sets
from caseflow.session import shuffle_partitions

WORDS = 5
PERCENT = 80          # similarity
SMALL = 32            # members of a region that is joined pair by pair
LATER = 1024          # times as many pairs a member are joined at once in later rounds
PAIRS_AT = 1 << 20    # pairs of members that one task compares by their bits
NEAREST = 2           # a member's nearest candidates that are checked first
WIDER = 8             # and so many times as many in the next step,
STEPS = 3             # all others after so many steps,
AT_ONCE = 1 << 17     # or once so few are left
BITS = 1024           # of a set, to bound the difference of two sets
BLOCK = 512           # sets at either end of the pairs of a block
MERGES = 3            # hashes of the members under which regions become one
PIVOTS = 4            # a region has 1, 4, 16, ... pivots in its rounds,
PER_PIVOT = 8         # but one for so many members at most
ROUNDS = 8
COUNT_AT = 4 << 20    # shingles that a task counts together
LOCAL_COUNT = 2       # and report from so many of one kind on (2 at least)
SLOTS = 1 << 24       # slots of estimated frequencies, a byte each
LEVELS = 4            # levels for each factor of two
HOT_COUNT = 64        # the region of a shingle with so many documents is not held in a task
ENTRIES_AT = 1 << 20  # entries that a task holds before it passes them on
FILTER_BITS = 1 << 24
SLICE = 2 << 20       # bytes of text in one vectorised step
RUN = 8 << 20         # bytes of text whose sets are unpacked together
CODEC = pa.Codec("zstd")  # of the texts that go to pairs


# ---- 1. sets and frequent shingles -------------------------------------------------

def slot_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(11)).astype(np.int64) & (SLOTS - 1)


def sets_and_counts(docs: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds: (doc_id, set, n) of a document, where ``set`` is null
    without shingles, and (slot, seen) of the slots that hold a shingle which a
    task has seen repeatedly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        held = 0

        def out(ids, sets, sizes, slots=(), counts=()):
            n, m = len(ids), len(slots)
            none = lambda k: [None] * k
            return pa.RecordBatch.from_arrays([
                pa.array([*ids, *none(m)], pa.int64()), pa.array([*sets, *none(m)], pa.int64()),
                pa.array([*sizes, *none(m)], pa.int64()), pa.array([*none(n), *slots], pa.int64()),
                pa.array([*none(n), *counts], pa.int64())], names=["doc_id", "set", "n", "slot", "seen"])

        def counted():
            flat = np.concatenate(list(seen.values()))
            seen.clear()
            flat.sort()
            # only what comes again is counted, which takes far less memory than all shingles
            found, more = np.unique(flat[1:][flat[1:] == flat[:-1]], return_counts=True)
            keep = more + 1 >= LOCAL_COUNT
            return out([], [], [], slot_of(found[keep]).tolist(), (more[keep] + 1).tolist())

        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                sets, sizes = [], []
                for s in shingle_sets(texts(part), words):
                    name = set_id(s) if len(s) else None
                    if len(s) and name not in seen:
                        seen[name] = s
                        held += len(s)
                    sets.append(name)
                    sizes.append(len(s))
                yield out(part.column("doc_id").to_pylist(), sets, sizes)
                if held >= COUNT_AT:
                    yield counted()
                    held = 0
        if seen:
            yield counted()

    return docs.mapInArrow(lean(run), "doc_id long, set long, n long, slot long, seen long")


def level(count):
    """Level of a number of documents; 0 for fewer than two."""
    return np.floor(np.log2(np.maximum(count, 1)) * LEVELS).astype(np.uint8)


def frequencies(rows: DataFrame) -> np.ndarray:
    """The level of every slot.  At most ``SLOTS`` numbers reach the driver."""
    got = (rows.where("slot is not null").groupBy("slot").agg(F.sum("seen").alias("seen"))
           .select(F.col("slot").cast("int").alias("slot"), F.col("seen")).toArrow())
    table = np.zeros(SLOTS, np.uint8)
    if got.num_rows:
        table[got["slot"].to_numpy()] = level(got["seen"].to_numpy())
    return table


# ---- 2. first regions ---------------------------------------------------------------

def ordered_prefix(s: np.ndarray, levels: np.ndarray, percent: int, hot: int) -> tuple[np.ndarray, int]:
    """The first shingles of a set, rare ones first, and how many are below
    the level ``hot``."""
    take = len(s) - -(-percent * len(s) // 100) + 1
    order = np.argsort(levels, kind="stable")[:take]  # a set is sorted by hash
    return s[order], int((levels[order] < hot).sum())


def entries(docs: DataFrame, levels, words: int, percent: int, parts: int, hot: int) -> DataFrame:
    """Blocks of entries (shingle, set, place, size) for each part.  Entries of
    frequent shingles are only passed on, so they go to any part."""
    names = ("shingle", "set", "place", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done, held, count = levels.value, set(), [], 0

        def flush():
            for is_hot in (False, True):
                e = [np.concatenate([h[is_hot][i] for h in held]) for i in range(4)]
                if not len(e[0]):
                    continue
                key = mixed_part(e[1] if is_hot else e[0], parts)
                order = np.argsort(key, kind="stable")
                e, key = [x[order] for x in e], key[order]
                at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                ends = np.r_[at[1:], len(key)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at], pa.int32()), pa.array([is_hot] * len(at))]
                    + [pa.array([x[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()) for x in e],
                    names=["part", "hot", *names])

        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                fresh = []
                for s in shingle_sets(texts(part), words):
                    name = set_id(s) if len(s) else None
                    if len(s) and name not in done:
                        done.add(name)
                        fresh.append((name, s))
                if not fresh:
                    continue
                flat = np.concatenate([s for _, s in fresh])
                of = known[slot_of(flat)]
                out: tuple = ([], [])
                at = 0
                for name, s in fresh:
                    first, cold = ordered_prefix(s, of[at:at + len(s)], percent, hot)
                    at += len(s)
                    place = np.arange(len(first), dtype=np.int32)
                    for h, (a, b) in enumerate(((0, cold), (cold, len(first)))):
                        if b > a:
                            out[h].append((first[a:b], name, place[a:b], len(s)))
                held.append([tuple(
                    np.concatenate([np.asarray(f(x)) for x in out[h]]) if out[h] else np.zeros(0, t)
                    for f, t in ((lambda x: x[0], np.uint64), (lambda x: np.full(len(x[0]), x[1], np.int64), np.int64),
                                 (lambda x: x[2], np.int32), (lambda x: np.full(len(x[0]), x[3], np.int32), np.int32)))
                    for h in (0, 1)])
                count += len(held[-1][0][0]) + len(held[-1][1][0])
                if count >= ENTRIES_AT:
                    yield from flush()
                    held, count = [], 0
                if len(done) > 1 << 19:
                    done = set()
        if held:
            yield from flush()

    return docs.mapInArrow(lean(run), "part int, hot boolean, shingle binary, set binary, place binary, size binary")


def mixed_part(x: np.ndarray, parts: int) -> np.ndarray:
    """Part of a hash, from its high bits (the low ones stay for the order)."""
    return ((x.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def least_overlap(n, m, percent: int):
    """The overlap that sets of sizes n and m need."""
    return -(-percent * (n + m) // (100 + percent))


def region_pairs(e: list[np.ndarray], percent: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets in small regions (entries sorted by shingle and set) that
    sizes and places allow."""
    shingle, name, place, size = e
    at = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    group = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(shingle)]))
    left, right = [], []
    for step in range(1, small):
        a = np.flatnonzero(group[step:] == group[:-step])
        if not len(a):
            break
        b = a + step
        most = np.minimum(size[a] - place[a], size[b] - place[b])
        ok = most >= least_overlap(size[a].astype(np.int64), size[b], percent)
        left.append(name[a[ok]])
        right.append(name[b[ok]])
    if not left:
        return name[:0], name[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first]


def first_regions(blocks_: DataFrame, percent: int, parts: int, small: int) -> DataFrame:
    """(region, a, b, size, rest): a pair of sets (region null), or a member
    ``a`` of a region of more than ``small`` sets or of a frequent shingle
    (b null), its size and the number of its shingles from this one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.uint64, np.int64, np.int32, np.int32)
        held: list[list[np.ndarray]] = []

        def rows(region, a, b, size, place):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()) if region is None else pa.array(region.view(np.int64)), pa.array(a),
                 pa.nulls(n, pa.int64()) if b is None else pa.array(b),
                 pa.nulls(n, pa.int64()) if size is None else pa.array(size.astype(np.int64)),
                 pa.nulls(n, pa.int64()) if size is None else pa.array((size - place).astype(np.int64))],
                names=["region", "a", "b", "size", "rest"])

        for batch in batches:
            for i in range(batch.num_rows):
                e = [np.frombuffer(batch.column(c)[i].as_py(), k) for c, k in
                     zip(("shingle", "set", "place", "size"), kinds)]
                if batch.column("hot")[i].as_py():
                    yield rows(e[0], e[1], None, e[3], e[2])
                else:
                    held.append(e)
        if held:
            e = [np.concatenate([h[i] for h in held]) for i in range(4)]
            order = np.lexsort((e[1], e[0]))
            e = [x[order] for x in e]
            # a set that several tasks have read comes several times
            first = np.r_[True, (e[0][1:] != e[0][:-1]) | (e[1][1:] != e[1][:-1])]
            e = [x[first] for x in e]
            at = np.flatnonzero(np.r_[True, e[0][1:] != e[0][:-1]])
            n = np.diff(np.r_[at, len(e[0])])
            n = np.repeat(n, n)
            large = n > small
            yield rows(e[0][large], e[1][large], None, e[3][large], e[2][large])
            few = (n > 1) & ~large
            a, b = region_pairs([x[few] for x in e], percent, small)
            yield rows(None, a, b, None, None)

    dealt = blocks_.repartitionById(parts, F.col("part"))
    return dealt.drop("part").mapInArrow(lean(run), "region long, a long, b long, size long, rest long")


# ---- 3. distances and regions with pivots ------------------------------------------

def packed(text: pa.Buffer, shingles: np.ndarray) -> bytes:
    """A set on its way to its pairs: the number of bytes of its text and the
    compressed text, or 0 and the shingles where these take less."""
    short = CODEC.compress(text, asbytes=True)
    if shingles.nbytes <= len(short):
        return bytes(8) + shingles.tobytes()
    return text.size.to_bytes(8, "little") + short


def text_size(data: pa.Buffer) -> int:
    return int.from_bytes(data[:8], "little")


def unpacked(items: list[pa.Buffer], words: int) -> list[np.ndarray]:
    """The shingles of packed sets."""
    sizes = [text_size(x) for x in items]
    found = [CODEC.decompress(x[8:], n, asbytes=True) for x, n in zip(items, sizes) if n]
    sets = shingle_sets(pa.array(found, pa.binary()).view(pa.string()), words)
    return [next(sets) if n else np.frombuffer(x, np.uint64, offset=8) for x, n in zip(items, sizes)]


def parities(s: np.ndarray) -> np.ndarray:
    """``BITS`` bits of a set, each the parity of the shingles that fall on it.
    Two sets differ in at least as many shingles as their bits differ."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets_of(docs: DataFrame, rows: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(set, packed, bits) of at least the sets named in ``needed`` (column
    ``set``), each from its document with the smallest id.  A bit map of
    bounded size drops most other rows before they are shuffled; what it lets
    pass by chance drops out in the joins."""
    pick = (rows.where("set is not null").join(needed, "set", "left_semi").groupBy("set")
            .agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("doc_id")))
    slot = F.pmod(F.col("set").bitwiseXOR(F.col("doc_id")), F.lit(FILTER_BITS)) + 1  # the maps number from 1
    maps = pick.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for k, m in maps:
        own = np.frombuffer(bytes(m), np.uint8)
        bits[(k - 1) * len(own):k * len(own)] = own
    wide = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = wide.value
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                out, data = {}, texts(part)
                for i, (s, doc) in enumerate(zip(shingle_sets(data, words), part.column("doc_id").to_pylist())):
                    if len(s):
                        name = set_id(s)
                        k = (name ^ (doc or 0)) % FILTER_BITS
                        if name not in out and have[k >> 3] >> (k & 7) & 1:
                            out[name] = packed(data[i].as_buffer(), s), parities(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(out), pa.int64()), pa.array([x for x, _ in out.values()], pa.binary()),
                     pa.array([x for _, x in out.values()], pa.list_(pa.int64()))], names=["set", "packed", "bits"])

    found = docs.mapInArrow(lean(run), "set long, packed binary, bits array<long>")
    return found.groupBy("set").agg(F.first("packed").alias("packed"), F.first("bits").alias("bits"))


def blocks(pairs: DataFrame) -> DataFrame:
    """``pairs`` with a ``block``.  Pairs whose sets meet the same sets come
    together: a set's home is the smallest set that it meets, and a pair goes to
    the smaller of its homes; where that has many sets, they are dealt out."""
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
    home = ends.union(ends.select("y", "x")).groupBy("x").agg(F.min(F.least("x", "y")).alias("h"))
    at = (pairs.join(home.select(F.col("x").alias("a"), F.col("h").alias("ha")), "a")
          .join(home.select(F.col("x").alias("b"), F.col("h").alias("hb")), "b")
          .withColumn("home", F.least("ha", "hb")).drop("ha", "hb"))
    at = written(at, "homes")
    big = at.groupBy("home").count().where(F.col("count") > BLOCK).select("home")
    if big.isEmpty():
        return at.withColumnRenamed("home", "block")
    big = at.join(big, "home", "left_semi")
    side = lambda c: big.select("home", c).distinct().groupBy("home").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).alias(f"n{c}"))
    deal = lambda c: F.pmod(F.xxhash64(c), F.coalesce(f"n{c}", F.lit(1)))
    return at.join(side("a").join(side("b"), "home"), "home", "left").withColumn(
        "block", F.xxhash64("home", deal("a"), deal("b"))).drop("home", "na", "nb")


def distances(pairs: DataFrame, sets: DataFrame, percent: int, words: int) -> DataFrame:
    """(a, b, d, linked) of pairs (a, b, exact): Jaccard distance, and whether
    the pair is similar, in whole numbers.  All pairs that are ``exact`` come
    back, and of the others the similar ones, but for those whose sets are
    already connected in their block.  A set goes once to each block that needs
    it, as its compressed text, about a third of its shingles."""

    def told(rows: list[tuple[int, int, bool]], need: dict[int, bytes], up: dict[int, int]) -> tuple:
        sets = dict(zip(need, unpacked([pa.py_buffer(x) for x in need.values()], words)))
        out: tuple = ([], [], [], [])

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for a, b, exact in rows:
            if not exact and top(a) == top(b):
                continue
            x, y = sets[a], sets[b]
            both = np.searchsorted(y, x)
            same = int((y[np.minimum(both, len(y) - 1)] == x).sum())
            union = len(x) + len(y) - same
            linked = 100 * same >= percent * union
            if linked:
                up[top(a)] = top(b)
            if linked or exact:
                for o, v in zip(out, (a, b, 1 - same / union, linked)):
                    o.append(v)
        return out

    def runs(rows: list[tuple[int, int, bool]], have: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        # a set is unpacked once for a run of pairs with about RUN bytes of text
        run, need, held, up = [], {}, 0, {}
        for n, row in enumerate(rows, 1):
            for name in row[:2]:
                if name not in need:
                    need[name] = have[name]
                    held += text_size(need[name]) or len(need[name])
            run.append(row)
            if held >= RUN or n == len(rows):
                a, b, d, linked = told(run, need, up)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64()),
                     pa.array(linked, pa.bool_())], names=["a", "b", "d", "linked"])
                run, need, held = [], {}, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, have, held, last = [], {}, 0, None
        for batch in batches:
            block, a, b, exact = (batch.column(c).to_pylist() for c in ("block", "a", "b", "exact"))
            data = batch.column("packed")
            for i in range(batch.num_rows):
                if block[i] != last:
                    if held >= SLICE:  # several small blocks at once
                        yield from runs(rows, have)
                        rows, have, held = [], {}, 0
                    last = block[i]
                if b[i] is not None:
                    rows.append((a[i], b[i], exact[i]))
                elif a[i] not in have:
                    have[a[i]] = data[i].as_py()
                    held += text_size(have[a[i]]) or len(have[a[i]])
        if rows:
            yield from runs(rows, have)

    pairs = blocks(pairs)
    where = pairs.select("block", F.col("a").alias("set")).union(pairs.select("block", "b")).distinct()
    sent = where.join(sets.select("set", "packed"), "set").select(
        "block", F.col("set").alias("a"), F.lit(None).cast("long").alias("b"),
        F.lit(False).alias("exact"), "packed")
    met = pairs.select("block", "a", "b", "exact", F.lit(None).cast("binary").alias("packed"))
    # sets before pairs, exact pairs before others
    return (sent.union(met).repartition("block").sortWithinPartitions("block", F.col("b").isNotNull(), F.desc("exact"))
            .mapInArrow(lean(run), "a long, b long, d double, linked boolean"))


def useful(regions: DataFrame, percent: int) -> DataFrame:
    """Members that sizes and places let be similar to some member.  A pair
    that meets first in this region needs an overlap that both its members
    still hold from here on; another member is no smaller than the region's
    smallest and holds no more than the region's largest rest."""
    bound = regions.groupBy("region").agg(F.min("size").alias("least"), F.max("rest").alias("most"))
    need = percent * (F.col("size") + F.greatest("least", F.ceil(F.col("size") * percent / 100)))
    return (regions.join(bound, "region").where(F.least("rest", "most") * (100 + percent) >= need)
            .select("region", "a", "size", "rest", "weight"))


def merged(regions: DataFrame, hashes: int = MERGES) -> DataFrame:
    """Regions (region, a, size, rest, weight) whose smallest members, by a hash, are the
    same become one, for several hashes in turn; regions with one member are
    none.  Two regions meet with the share of members they have in common as
    probability, so nearly equal ones do; a union holds every pair of its
    regions and no more members than they.  Of its rests a member keeps the
    largest; its weight is the number of first regions that it was in, most for
    members in the middle of a family, whose first shingles are all common."""
    for salt in range(hashes):
        own = regions.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("a", F.lit(salt))).alias("m"))
        regions = (regions.join(own.where("n > 1").select("region", "m"), "region")
                   .groupBy(F.col("m").alias("region"), "a", "size").agg(
                       F.max("rest").alias("rest"), F.sum("weight").alias("weight")))
    return regions


def different(regions: DataFrame) -> DataFrame:
    """Regions (region, a, size, rest, weight) with the same members are one, and those
    with one member are none.  Members are compared by their number and two
    64-bit digests; of its rests and weights a member keeps the largest."""
    own = regions.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a")).alias("x"),
        F.bit_xor(F.xxhash64("a", F.lit(1))).alias("y")).where("n > 1")
    same = own.withColumn("first", F.min("region").over(Window.partitionBy("n", "x", "y"))).select("region", "first")
    return (regions.join(same, "region").groupBy(F.col("first").alias("region"), "a", "size")
            .agg(F.max("rest").alias("rest"), F.max("weight").alias("weight")))


def unconnected(regions: DataFrame, comp: DataFrame) -> DataFrame:
    """Regions whose members are not all in one component, with ``comp``."""
    known = regions.join(comp.select(F.col("node").alias("a"), "comp"), "a", "left").withColumn(
        "comp", F.coalesce("comp", "a"))
    state = known.groupBy("region").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    return known.join(state.where("x <> y").select("region"), "region")


def member_pairs(few: DataFrame, percent: int, bits: DataFrame | None) -> DataFrame:
    """Pairs (region, a, b, ca, cb, apart) of members of different components
    that sizes, places and, with ``bits``, these allow; ``a`` is outside its
    region's main component.  All members meet those outside, so the work is
    about the pairs wanted; large regions are compared by several tasks."""
    apart = F.lit(0)
    allowed = F.least("l.rest", "r.rest") * (100 + percent) >= percent * (F.col("l.size") + F.col("r.size"))
    left, right, on = few.where("comp <> main"), few, ["region"]
    if bits is not None:
        longs = range(BITS // 64)
        few = few.join(bits.select("a", *[F.col("bits")[i].alias(f"w{i}") for i in longs]), "a")
        n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("all") / PAIRS_AT))).cast("int")
        own, each = F.pmod(F.xxhash64("a"), n).cast("int"), F.explode(F.sequence(F.lit(0), n - 1))
        on, parts = ["region", "row", "col"], shuffle_partitions(few.sparkSession)
        left = few.where("comp <> main").withColumn("row", own).withColumn("col", each).repartition(parts, *on)
        right = few.withColumn("row", each).withColumn("col", own).repartition(parts, *on)
        apart = F.expr(" + ".join(f"bit_count(l.w{i} ^ r.w{i})" for i in longs))
        # so many shingles at most are in one of two similar sets only
        allowed = allowed & (apart * (100 + percent) <= (F.col("l.size") + F.col("r.size")) * (100 - percent))
    return left.alias("l").join(right.alias("r"), on).where(
        "l.comp <> r.comp and (r.comp = r.main or l.a < r.a)").where(close("l.size", "r.size", percent / 100)).where(
        allowed).select("region", F.col("l.a").alias("a"), F.col("r.a").alias("b"), F.col("l.comp").alias("ca"),
                        F.col("r.comp").alias("cb"), apart.cast("int").alias("apart"))


def split_regions(regions: DataFrame, comp: DataFrame | None, round_: int, small: int, percent: int,
                  bits: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the regions (region, a, size, rest, weight) that are not yet connected: the
    pairs of different components that sizes and places allow in those with few
    such pairs a member (see ``member_pairs``), the members of the others, and these
    regions' pivots (region, b, b_size).  A region of the first kind with more than
    two allowed pairs a member is dense; in the first round, where nothing is
    connected yet, it gets a pivot too."""
    known = regions if comp is not None else regions.withColumn("comp", F.col("a"))
    count = known.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("region").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max_by("comp", "c").alias("main"))
    # pairs of different components are (n * n - squares) / 2
    count = count.where("n > 1").withColumn("all", F.col("n").cast("double") * F.col("n") - F.col("squares")).withColumn(
        "few", F.col("all") <= F.col("n") * (small * (LATER if round_ else 1) - 1))
    known = written(known.join(count.drop("squares"), "region"), "regions")
    few = known.where("few")
    pairs = member_pairs(few, percent, bits)
    large = known.where("not few").select("region", "a", "size", "rest", "weight", "n")
    if not round_:
        pairs = written(pairs, "small-pairs")
        ends = pairs.select("region", "a").union(pairs.select("region", "b")).groupBy("region", "a").count()
        dense = ends.groupBy("region").agg(F.sum("count").alias("c"), F.count(F.lit(1)).alias("m")).where(
            "c > 4 * m").select("region")
        inside = few.join(ends.join(dense, "region").select("region", "a"), ["region", "a"], "left_semi")
        large = large.union(inside.select("region", "a", "size", "rest", "weight", "n"))
        pairs = pairs.join(dense, "region", "left_anti")
    large = written(large, "members")
    # no more than one pivot for so many members
    most = F.greatest(F.lit(1), F.least(F.lit(PIVOTS ** round_), F.floor(F.col("n") / PER_PIVOT)))
    salt = F.pmod(F.xxhash64("a", F.lit(round_)), most)
    pivots = large.groupBy("region", salt.alias("salt")).agg(
        F.min(F.struct(-F.col("weight"), F.col("a"), F.col("size"))).alias("p")).select(
        "region", F.col("p.a").alias("b"), F.col("p.size").alias("b_size"))
    return pairs.drop("region"), large.drop("n"), written(pivots, "pivots")


def close(n: str, m: str, least: float):
    """Can sets of these sizes have a similarity of ``least``?"""
    return F.least(n, m) >= F.greatest(n, m) * (least - 1e-9)


def next_regions(members: DataFrame, pivots: DataFrame, known: DataFrame, r: float) -> DataFrame:
    """Regions after the distances (``known``) to the pivots are there, see the
    module text.  ``slack`` keeps rounding from dropping a pair."""
    slack = 1e-9
    # only distances up to 2r matter: other members of a region are outside this pivot's core and window
    near = known.where(F.col("d") <= 2 * r + slack).join(pivots.select("region", "b"), "b")
    to = near.join(members, ["region", "a"]).join(
        pivots.select("region", F.col("b").alias("a")), ["region", "a"], "left_anti")
    to = written(to, "to-pivots")
    home = to.where("linked").groupBy("region", "a", "size", "rest", "weight").agg(F.min(F.struct("d", "b")).alias("h"))
    taken = home.select("region", "a").union(pivots.select("region", F.col("b").alias("a")))
    outer = members.join(taken, ["region", "a"], "left_anti").select(
        F.xxhash64("region", F.lit(-1)).alias("region"), "a", "size", "rest", "weight")
    window = to.where(~F.col("linked") & (F.col("d") <= 2 * r + slack))
    inner = F.xxhash64("region", "b").alias("region")
    least = window.groupBy("region", "b").agg(F.min("d").alias("m"))
    core = (home.select("region", "a", "size", "rest", "weight", F.col("h.b").alias("b"), F.col("h.d").alias("d"))
            .join(least, ["region", "b"]).where(F.col("d") >= F.col("m") - r - slack))
    return outer.union(core.select(inner, "a", "size", "rest", "weight")).union(
        window.select(inner, "a", "size", "rest", "weight")).distinct()


# ---- 4. the join --------------------------------------------------------------------

def connecting(pairs: DataFrame, sets: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (a, b) that connect what the similar ones of all ``pairs`` (see
    ``member_pairs``) connect.  A member's nearest candidates by bits are checked
    first; pairs whose components these have connected are not checked."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
    todo = pairs.groupBy("a", "b").agg(F.min("apart").alias("apart"), F.first("ca").alias("ca"),
                                       F.first("cb").alias("cb")).withColumn("rank", rank).drop("apart")
    todo, links = written(todo, "candidates"), pairs.select("a", "b").limit(0)
    for step in range(STEPS + 1):
        if not (n := todo.count()):
            break
        last = step == STEPS or n <= AT_ONCE
        near = F.lit(True) if last else F.col("rank") <= NEAREST * WIDER ** step
        known = written(distances(todo.where(near).select("a", "b", F.lit(False).alias("exact")), sets, percent, words),
                        "distances").select("a", "b")
        links = links.union(known)
        if last:
            break
        comp = written(components(todo.join(known, ["a", "b"], "left_semi").select(
            F.col("ca").alias("a"), F.col("cb").alias("b"))), "components")
        for c in ("ca", "cb"):
            todo = todo.join(comp.select(F.col("node").alias(c), F.col("comp").alias("to")), c, "left").withColumn(
                c, F.coalesce("to", c)).drop("to")
        todo = written(todo.where(~near & (F.col("ca") != F.col("cb"))), "candidates")
    return links


def similar_links(docs: DataFrame, rows: DataFrame, levels: np.ndarray, words: int, percent: int,
                  small: int = SMALL, hot_count: int = HOT_COUNT) -> DataFrame:
    """Links (a, b) between sets that connect exactly the sets which chains of
    similar pairs connect."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    found = written(first_regions(entries(docs, spark.sparkContext.broadcast(levels), words, percent, parts,
                                          int(level(hot_count))), percent, parts, small), "regions")
    pairs = found.where("region is null").select("a", "b").distinct()
    regions = written(merged(useful(
        found.where("region is not null").select("region", "a", "size", "rest", F.lit(1).cast("long").alias("weight"))
        .distinct(), percent)), "regions")
    r, round_, comp, links, sets, bits = 1 - percent / 100, 0, None, None, None, None
    while True:
        more, members, pivots = split_regions(regions, comp, round_, small, percent, bits)
        left = not members.isEmpty()
        if left and round_ >= ROUNDS:  # an exact way for what is left
            own = members.join(comp.select(F.col("node").alias("a"), "comp"), "a", "left").withColumn(
                "comp", F.coalesce("comp", "a"))
            more = more.union(own.alias("l").join(own.alias("r"), "region").where("l.a < r.a and l.comp <> r.comp").select(
                F.col("l.a").alias("a"), F.col("r.a").alias("b"), F.col("l.comp").alias("ca"),
                F.col("r.comp").alias("cb"), F.lit(0).alias("apart")))
            left = False
        exact = lambda df, yes: df.select("a", "b", F.lit(yes).alias("exact"))
        todo = None if round_ else exact(pairs.union(more.select(F.least("a", "b"), F.greatest("a", "b"))), False)
        if left:
            to = exact(members.join(pivots, "region").where("a <> b").where(close("size", "b_size", 1 - 2 * r)), True)
            todo = todo.union(to) if todo is not None else to
        if todo is not None:
            todo = written(todo.groupBy("a", "b").agg(F.max("exact").alias("exact")), "pairs")
        if not round_:  # shuffled once for all pairs
            names = todo.select(F.col("a").alias("set")).union(todo.select("b"))
            sets = sets_of(docs, rows, names.union(members.select("a")).distinct(), words)
            if left:  # read again after this round
                sets = written(sets, "sets")
        else:
            links = links.union(connecting(more, sets, percent, words))
        if todo is not None:
            known = written(distances(todo, sets, percent, words), "distances")
            new = known.where("linked").select("a", "b")
            links = new if links is None else links.union(new)
        if not left:
            return links
        comp = written(components(links), "components")
        regions = written(unconnected(different(useful(next_regions(members, pivots, known, r), percent)), comp),
                          "regions")
        if not round_:  # later regions only hold members of these
            sets = written(sets.join(regions.select(F.col("a").alias("set")).distinct(), "set", "left_semi"), "sets")
            bits = sets.select(F.col("set").alias("a"), "bits")
        round_ += 1


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                 text_col: str = "text", small: int = SMALL, hot_count: int = HOT_COUNT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = id_text(docs, id_col, text_col)
    rows = written(sets_and_counts(docs, words), "sets-and-counts")
    links = similar_links(docs, rows, frequencies(rows), words, percent, small, hot_count)
    comp = components(links).select(F.col("node").alias("set"), "comp")
    own = rows.where("n is not null").select("doc_id", "set", "n").join(comp, "set", "left").withColumn(
        "comp", F.coalesce("comp", "set"))
    first = own.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("first"))
    return own.join(first, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))
