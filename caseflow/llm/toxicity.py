"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters inside words, one of toxic and one of ordinary
labelled texts.  The counts of sequences of ``ORDER`` letters belong to a
class, each discounted; what is taken off, and ``STRENGTH`` occurrences more,
is given to an estimate that both classes share: interpolated Kneser-Ney over
the counts of both, with continuation counts in all lower orders (sequences at
the start of a word, which have no left neighbour, keep their own counts).  So
the classes differ by what they have seen often, and rare expressions weigh
about the same in both.

A word's log-likelihood ratio is the sum over its letters.  Texts are compared
by ratios divided by length: of the whole text, of its most toxic passage of
``PASSAGE`` words and of its ``TOP`` most toxic words, so that an insult in a
long text counts.  A logistic function of these numbers (``features``) gives
the score.  It is fitted on at most about ``CALIBRATE`` texts of each label,
each rated by a model of the other half of the labelled texts; numbers beyond
those of these texts count as the outermost of them.

All labelled texts are counted, in Spark; the counts grow with them.  What the
tasks look up is a table of at most ``SLOTS`` sequences (12 bytes each), one a
slot; where sequences meet in a slot, the most frequent one has it, and the
others, at most ``MORE``, are found in a sorted list.  Sequences beyond both stay
in Spark: words with a sequence that the table does not hold are spelled and
joined with them, and their texts take those words' ratios from the join
(``with_rest_words``).  So every sequence counts, and the results depend on
neither bound.

Defined results: a null text is the empty text; a text without words gets the
share of toxic labels; without labelled rows every score is 0, with labels of
one kind only it is that label.  A text with several labels is toxic if one of
them is 1; null labels and null ids teach nothing.  Repeated rows get equal
scores.  Further columns of any name are ignored or, in ``score``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import free_name, quoted, slices, texts, written

ORDER = 6
DISCOUNT = 0.75
STRENGTH = 8.0      # occurrences that the shared estimate counts for in each class
SHARED = 2          # orders estimated for all sequences at once
PASSAGE, TOP, USED = 8, 5, 4
CALIBRATE = 3000
SLOTS = 1 << 22
MORE = 1 << 21      # sequences beside the slots
MANY = 1 << 16      # occurrences told apart when the most frequent of those are chosen
BITS, EDGE = 6, 61  # bits of a symbol; the symbol between words (0: nothing)
MIX = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS, BUCKET = 1 << 26, 1 << 15


def low(k: int) -> int:
    return (1 << BITS * k) - 1


def words(data: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word codes of all texts in a row, where each text starts (and the end),
    and the distinct words."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(data))
    flat = lists.flatten().dictionary_encode()
    known = flat.dictionary.to_pylist()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    if "" in known:  # at white space at either end of a text
        real = codes != known.index("")
        offsets = np.r_[0, np.cumsum(real)][offsets]
        codes = codes[real]
    return codes, offsets, known


def symbols(cp: np.ndarray) -> np.ndarray:
    """Symbols 1 to 61 of code points: letters, one for digits, one for other
    ASCII characters, 32 for the rest."""
    s = np.where(cp >= 128, 29 + cp % 32, 28)
    s = np.where((cp >= 97) & (cp <= 122), cp - 96, s)
    s = np.where((cp >= 48) & (cp <= 57), 27, s)
    return np.where(cp == 32, EDGE, s).astype(np.int64)


def grams(known: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each letter and the end of each word: the last ``ORDER`` symbols of
    the word up to there, the newest in the lowest bits; and the word."""
    if not known:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = " " + " ".join(known) + " "
    s = symbols(np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32))
    size = np.fromiter(map(len, known), np.int64, len(known))
    ends = np.cumsum(size + 1)
    of = np.repeat(np.arange(len(known)), size + 1)
    at = np.arange(1, len(s))
    since = at - np.r_[0, ends[:-1]][of]  # symbols since the edge before the word
    code = np.zeros(len(at), np.int64)
    for j in range(ORDER):
        code |= np.where(j <= since, s[np.maximum(at - j, 0)], 0) << BITS * j
    return code, of


def count_grams(rows: DataFrame) -> DataFrame:
    """``g``, ``fold``, ``t``, ``o``: occurrences in toxic and ordinary texts
    of the rows ``text``, ``label`` (0, 1), ``fold`` (0, 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes, offsets, known = words(texts(part))
                kind = part.column("label").to_numpy() + 2 * part.column("fold").to_numpy()
                of = np.repeat(kind, np.diff(offsets))
                times = np.zeros((len(known), 4), np.int64)
                np.add.at(times, (codes, of), 1)
                g, word = grams(known)
                distinct, back = np.unique(g, return_inverse=True)
                n = np.stack([np.bincount(back, times[word, c], len(distinct)) for c in range(4)], 1).astype(np.int64)
                for fold in (0, 1):
                    o, t = n[:, 2 * fold], n[:, 2 * fold + 1]
                    seen = np.flatnonzero(o + t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(distinct[seen]), pa.array(np.full(len(seen), fold), pa.int32()),
                         pa.array(t[seen]), pa.array(o[seen])], names=["g", "fold", "t", "o"])

    return (rows.mapInArrow(run, "g long, fold int, t long, o long")
            .groupBy("g", "fold").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))


def _context_sums(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each sequence: its context's place; for each context: the context,
    its occurrences and the number of symbols seen after it."""
    h, place = np.unique(g >> BITS, return_inverse=True)
    return place, h, np.bincount(place, n, len(h)), np.bincount(place, n > 0, len(h))


def _lower(g: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of order ``k`` with their Kneser-Ney counts, from those of
    order ``k + 1``, and where each of these has its own."""
    starts = (g >> BITS * k) & 63 == 0
    shorter, place = np.unique(g & low(k), return_inverse=True)
    return shorter, np.bincount(place, np.where(starts, n, 1), len(shorter)), place


def _smoothed(g: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    place, _, total, kinds = _context_sums(g, n)
    return (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds[place] * q) / total[place]


def pair_estimate(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shared estimate of orders 1 and 2 (64 x 64 numbers) from the sequences
    of order 3: raw occurrences where they start a word, else any number."""
    two, b, _ = _lower(g, n, 2)
    one, c, place = _lower(two, b, 1)
    out = np.zeros(1 << 2 * BITS)
    out[two] = _smoothed(two, b, ((c + 1) / (c.sum() + 64))[place]) if len(two) else 0.0
    return out


def group_entries(g: np.ndarray, t: np.ndarray, o: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys, log ratios and occurrences of the table, from all sequences of a
    group that shares the last two symbols before the newest: what belongs to
    one context, and every shorter form down to order 3, is in one group."""
    chain, n = [(g, (t + o).astype(float), None)], (t + o).astype(float)
    for k in range(ORDER - 1, SHARED, -1):
        chain.append(_lower(chain[-1][0], chain[-1][1], k))
    q = pairs[chain[-1][0] & low(SHARED)]
    for shorter, b, place in reversed(chain):
        q = _smoothed(shorter, b, q)
        if place is not None:
            q = q[place]
    place, h, all_t, kinds_t = _context_sums(g, t.astype(float))
    _, _, all_o, kinds_o = _context_sums(g, o.astype(float))
    left_t = (DISCOUNT * kinds_t + STRENGTH) / (all_t + STRENGTH)
    left_o = (DISCOUNT * kinds_o + STRENGTH) / (all_o + STRENGTH)
    p_t = np.maximum(t - DISCOUNT, 0) / (all_t + STRENGTH)[place] + left_t[place] * q
    p_o = np.maximum(o - DISCOUNT, 0) / (all_o + STRENGTH)[place] + left_o[place] * q
    return (np.r_[g, h | 1 << BITS * ORDER], np.r_[np.log(p_t / p_o), np.log(left_t / left_o)],
            np.r_[n, all_t + all_o].astype(np.int64))


def table_entries(counts: DataFrame) -> DataFrame:
    """``model``, ``key``, ``value``, ``n`` of the table: the log ratio of each
    sequence, and of each context's weights for sequences that none has seen;
    for the models 0 (all texts), 1 and 2 (without those of fold 0 or 1)."""
    three = F.col("g").bitwiseAND(F.lit(low(3)).cast("long"))
    # at most 2 x 64^3 rows
    tails = counts.groupBy(three.alias("g"), "fold").agg(F.sum(F.col("t") + F.col("o")).alias("n")).toArrow()
    g3, fold3, n3 = (tails.column(c).to_numpy() for c in ("g", "fold", "n"))
    pairs = {}
    for model in (0, 1, 2):
        own = fold3 != model - 1
        seq, place = np.unique(g3[own], return_inverse=True)
        pairs[model] = pair_estimate(seq, np.bincount(place, n3[own], len(seq)))

    def build(rows: pa.Table) -> pa.Table:
        g, fold, t, o = (rows.column(c).to_numpy() for c in ("g", "fold", "t", "o"))
        out = []
        for model in (0, 1, 2):
            own = fold != model - 1
            if not own.any():
                continue
            seq, place = np.unique(g[own], return_inverse=True)
            key, value, n = group_entries(seq, *(np.bincount(place, c[own], len(seq)).astype(np.int64) for c in (t, o)),
                                          pairs[model])
            out.append(pa.table({"model": pa.array(np.full(len(key), model), pa.int32()), "key": key,
                                 "value": value, "n": n}))
        return pa.concat_tables(out)

    pair = F.shiftright("g", BITS).bitwiseAND(F.lit(low(2)).cast("long"))
    return counts.withColumn("pair", pair).groupBy("pair").applyInArrow(
        build, "model int, key long, value double, n long")


def slot(keys: np.ndarray, slots: int) -> np.ndarray:
    x = keys.astype(np.uint64) * MIX
    return ((x ^ x >> np.uint64(32)) * MIX >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


@dataclass
class Table:
    """Sequences by slot: ``keys`` (-1: free) and ``values``; those without a
    slot of their own in the order of ``more_keys``; ``partial``: others are left."""

    keys: np.ndarray
    values: np.ndarray
    more_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    more_values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    partial: bool = False

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = slot(keys, len(self.keys))
        hit = self.keys[at] == keys
        value = np.where(hit, self.values[at], 0.0)
        if len(self.more_keys):
            left = np.flatnonzero(~hit)
            at = np.minimum(np.searchsorted(self.more_keys, keys[left]), len(self.more_keys) - 1)
            found = self.more_keys[at] == keys[left]
            hit[left[found]], value[left[found]] = True, self.more_values[at[found]]
        return hit, value

    def ratios(self, known: list[str]) -> np.ndarray:
        """Log ratio of each word: toxic against ordinary."""
        g, of = grams(known)
        hit, value = self.find(g)
        new = np.flatnonzero(~hit)
        value[new] = self.find(context(g[new]))[1]
        return np.bincount(of, value, len(known))

    def unsure(self, known: list[str]) -> np.ndarray:
        """Whether a word has a sequence that the table does not hold."""
        g, of = grams(known)
        return np.bincount(of, ~self.find(g)[0], len(known)) > 0


def context(g: np.ndarray) -> np.ndarray:
    """Keys of the contexts of sequences."""
    return g >> BITS | 1 << BITS * ORDER


def _placed(entries: DataFrame, slots: int, more: int) -> DataFrame:
    """The entries with their ``slot`` and ``place``: 0 has the slot, 1 is among
    the (at most ``more`` a model) most frequent of the others, 2 is left."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = slot(b.column("key").to_numpy(), slots)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "slot"])

    first = Window.partitionBy("model", "slot").orderBy(F.desc("n"), F.desc("key"), F.desc("value"))
    ranked = written(entries.select("model", "key", "value", "n")
                     .mapInArrow(put, "model int, key long, value double, n long, slot long")
                     .withColumn("own", F.row_number().over(first) == 1), "gram-slots")
    # at most MANY rows a model
    times = (ranked.where(~F.col("own")).groupBy("model", F.least("n", F.lit(MANY)).alias("n"))
             .agg(F.count(F.lit(1)).alias("c")).toArrow())
    model, n, c = (times.column(x).to_numpy() for x in ("model", "n", "c"))
    place = F.lit(1)
    for m in np.unique(model).tolist():
        order = np.flatnonzero(model == m)[np.argsort(-n[model == m])]
        fit = int((np.cumsum(c[order]) <= more).sum())
        if fit < len(order):
            place = F.when((F.col("model") == m) & (F.least("n", F.lit(MANY)) <= int(n[order[fit]])), 2).otherwise(place)
    return ranked.select("model", "key", "value", "slot", F.when(F.col("own"), 0).otherwise(place).alias("place"))


def _read(placed: DataFrame, models: tuple[int, ...], slots: int) -> dict[int, Table]:
    """One entry of each slot and at most ``more`` others reach the driver."""
    left = {r[0] for r in placed.where("place = 2").select("model").distinct().collect()}
    out = {}
    for m in models:
        got = placed.where((F.col("model") == m) & (F.col("place") < 2)).select("key", "value", "slot", "place").toArrow()
        key, value, at, place = (got.column(c).to_numpy() for c in ("key", "value", "slot", "place"))
        own, more = place == 0, np.flatnonzero(place == 1)
        more = more[np.argsort(key[more])]
        table = Table(np.full(slots, -1, np.int64), np.zeros(slots, np.float32), key[more],
                      value[more].astype(np.float32), m in left)
        table.keys[at[own]], table.values[at[own]] = key[own], value[own]
        out[m] = table
    return out


def _tables(entries: DataFrame, models: tuple[int, ...], slots: int, more: int = MORE) -> dict[int, Table]:
    return _read(_placed(entries, slots, more), models, slots)


def with_rest_words(rows: DataFrame, tables, rest: DataFrame, model: Column, name: str,
                    text_col: str = "text") -> DataFrame:
    """``rows`` with the column ``name``: ``word`` and ``ratio`` of those words of
    the text that have a sequence which the table of their ``model`` (broadcast
    ``tables``) does not hold, by joins with the entries ``rest``."""

    def unsure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes, offsets, known = words(texts(part))
                of = np.repeat(part.column("model").to_numpy(), np.diff(offsets))
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                for m in np.unique(of).tolist():
                    open_ = tables.value[m].unsure(known)[codes] & (of == m)
                    r, c = np.unique(np.stack([row[open_], codes[open_]]), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("digest").take(pa.array(r)), pa.array(np.full(len(r), m), pa.int32()),
                         pa.array(known, pa.string()).take(pa.array(c))], names=["digest", "model", "word"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word"):
                model_of = part.column("model").to_numpy()
                for m in np.unique(model_of).tolist():
                    known = part.column("word").take(pa.array(np.flatnonzero(model_of == m)))
                    g, of = grams(known.to_pylist())
                    hit, value = tables.value[m].find(g)
                    back, other = tables.value[m].find(context(g))
                    none = -1 - np.arange(len(g))  # keys of no entry, spread over the tasks
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(g), m), pa.int32()), known.take(pa.array(of)), pa.array(np.arange(len(g))),
                         pa.array(np.where(hit, none, g)), pa.array(np.where(hit | back, none, context(g))),
                         pa.array(value, pa.float64(), mask=~hit), pa.array(other, pa.float64(), mask=~back)],
                        names=["model", "word", "at", "key", "context", "value", "back"])

    one = F.col("value").cast("float").cast("double")  # as the table holds them
    by_key = rest.select("model", "key", one.alias("rest_value"))
    by_context = rest.select("model", F.col("key").alias("context"), one.alias("rest_back"))
    digest = F.sha2(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), 256)
    found = (rows.select(digest.alias("digest"), model.cast("int").alias("model"),
                         F.col(quoted(text_col)).cast("string").alias("text"))
             .mapInArrow(unsure, "digest string, model int, word string").distinct())
    # summed in the order of the letters, as ``ratios`` does
    ratios = (found.select("model", "word").distinct()
              .mapInArrow(spell, "model int, word string, at long, key long, context long, value double, back double")
              .join(by_key, ["model", "key"], "left").join(by_context, ["model", "context"], "left")
              .select("model", "word", "at", F.coalesce("value", "rest_value", "back", "rest_back", F.lit(0.0)).alias("v"))
              .groupBy("model", "word").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("all"))
              .select("model", "word", F.aggregate("all", F.lit(0.0), lambda total, x: total + x["v"]).alias("ratio")))
    d, m = free_name(rows, "_digest"), free_name(rows, "_model")
    of_text = (found.join(ratios, ["model", "word"]).groupBy("digest", "model")
               .agg(F.collect_list(F.struct("word", "ratio")).alias(name))
               .select(F.col("digest").alias(d), F.col("model").alias(m), name))
    return rows.withColumn(d, digest).withColumn(m, model.cast("int")).join(of_text, [d, m], "left").drop(d, m)


def rest_words(batch: pa.RecordBatch, name: str) -> dict[str, float]:
    """Ratios of the words that ``with_rest_words`` has added to a batch."""
    flat = batch.column(name).flatten()
    return dict(zip(pc.struct_field(flat, "word").to_pylist(), pc.struct_field(flat, "ratio").to_pylist()))


def features(table: Table, data: pa.Array, cache: dict[str, float],
             rest: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Rows of ``USED`` numbers, the ratios of the texts, and the most toxic
    passages.  The numbers: ratio of that passage for each symbol, mean ratio
    of the ``TOP`` most toxic words, root mean square of what words have above
    a ratio of 1, and the logarithm of the number of words (-1: no word).
    ``rest``: ratios of words that the table alone cannot give."""
    codes, offsets, known = words(data)
    rest = rest or {}
    cache.update(rest)
    new = [w for w in known if w not in cache]
    if len(cache) + len(new) > 1_000_000:
        cache.clear()
        cache.update(rest)
        new = [w for w in known if w not in cache]
    cache.update(zip(new, table.ratios(new).tolist()))
    ratio = np.fromiter((cache[w] for w in known), float, len(known))[codes]
    size = (np.fromiter(map(len, known), float, len(known)) + 1)[codes]
    sums, sizes = np.r_[0, np.cumsum(ratio)], np.r_[0, np.cumsum(size)]
    excess = np.r_[0, np.cumsum(np.maximum(ratio - 1, 0) ** 2)]
    n = len(offsets) - 1
    out, mean, worst = np.zeros((n, USED)), np.zeros(n), [""] * n
    out[:, 3] = -1
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if a == b:
            continue
        first = np.arange(a, max(a + 1, b - PASSAGE + 1))
        last = np.minimum(first + PASSAGE, b)
        each = (sums[last] - sums[first]) / (sizes[last] - sizes[first])
        best = int(each.argmax())
        own = ratio[a:b]
        top = own if b - a <= TOP else np.partition(own, b - a - TOP)[-TOP:]
        out[i] = each[best], top.mean(), np.sqrt(max(0.0, excess[b] - excess[a]) / (b - a)), np.log(b - a)
        mean[i] = (sums[b] - sums[a]) / (sizes[b] - sizes[a])
        worst[i] = " ".join(known[c] for c in codes[first[best]:last[best]])
    return out, mean, worst


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights of the columns and of the constant, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.diag(np.r_[np.full(len(w) - 1, penalty), 1e-9]) * weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge,
                               x.T @ (weight * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicModel:
    prior: float
    table: Table | None = None
    rest: DataFrame | None = None  # entries that the table does not hold
    centre: np.ndarray = field(default_factory=lambda: np.zeros(USED))
    scale: np.ndarray = field(default_factory=lambda: np.ones(USED))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(USED + 1))
    low: np.ndarray = field(default_factory=lambda: np.full(USED, -np.inf))
    high: np.ndarray = field(default_factory=lambda: np.full(USED, np.inf))

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.full(len(rows), self.prior)
        z = np.c_[(np.clip(rows, self.low, self.high) - self.centre) / self.scale, np.ones(len(rows))] @ self.weights
        return np.where(rows[:, 3] >= 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), self.prior)


def with_ids_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that may have one of the ``doc_id`` of ``ids``: a bitmap of
    ``FILTER_BITS`` bits (a fixed 8 MB, broadcast) holds the hashes of the ids,
    so that few other texts go into the join that follows and decides."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bucket, bit = F.floor(at / BUCKET).cast("int"), (at % BUCKET).cast("int")
    bits = (ids.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket")
            .agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.get(F.array(*[byte.bitwiseAND(F.lit(1 << i)) for i in range(8)]), F.col("_bit") % 8) > 0
    return (rows.withColumn("_bucket", bucket).withColumn("_bit", bit).join(F.broadcast(bits), "_bucket")
            .where(hit).drop("_bucket", "_bit", "_bits"))


def labelled(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``text``, ``label``, ``fold`` and ``h`` of the rows to learn from."""
    known = (labels.select(F.col(quoted(id_col)).cast("long").alias("doc_id"),
                           F.col(quoted(label_col)).cast("int").alias("label"))
             .where(learn_from & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label")))
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"),
                       F.col(quoted(text_col)).cast("string").alias("text")).where(learn_from)
    h = F.xxhash64("doc_id")
    return with_ids_of(rows, known).join(known, "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"), "label", F.pmod(h, F.lit(2)).cast("int").alias("fold"),
        F.pmod(F.shiftright(h, 1), F.lit(1 << 40)).alias("h"))


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", calibrate: int = CALIBRATE, slots: int = SLOTS, more: int = MORE) -> ToxicModel:
    """The model of the texts whose id satisfies ``learn_from`` (a condition on
    ``doc_id``) and that have a label."""
    rows = written(labelled(docs, labels, learn_from, id_col, text_col, label_col), "labelled-texts")
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return ToxicModel(float(next(iter(n), 0)))
    prior = n[1] / (n[0] + n[1])
    entries = written(table_entries(written(count_grams(rows), "gram-counts")), "gram-table")
    most = max(1, *(r[1] for r in entries.groupBy("model").count().collect()))
    slots = min(slots, 1 << max(10, (4 * most).bit_length()))
    placed = _placed(entries, slots, more)
    tables = _read(placed, (0, 1, 2), slots)
    rest = placed.where("place = 2").select("model", "key", "value")
    by_join = any(tables[m].partial for m in (1, 2))
    held = docs.sparkSession.sparkContext.broadcast({m: tables.pop(m) for m in (1, 2)})

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches: dict[int, dict] = {1: {}, 2: {}}
        for batch in batches:
            for part in slices(batch):
                fold = part.column("fold").to_numpy()
                for f in (0, 1):  # a text is rated by the model without its fold
                    own = part.take(pa.array(np.flatnonzero(fold == f)))
                    if own.num_rows:
                        x, _, _ = features(held.value[f + 1], texts(own), caches[f + 1],
                                           rest_words(own, "rest_words") if by_join else None)
                        yield pa.RecordBatch.from_arrays([own.column("label"), own.column("h"), *map(pa.array, x.T)],
                                                         names=["label", "h", "a", "b", "c", "d"])

    part = F.when(F.col("label") == 1, min(1.0, calibrate / n[1])).otherwise(min(1.0, calibrate / n[0]))
    rated = rows.where(F.col("h") < part * float(1 << 40))
    if by_join:
        rated = with_rest_words(rated, held, rest, F.col("fold") + 1, "rest_words")
    sample = (rated.mapInArrow(rate, "label int, h long, a double, b double, c double, d double")
              .where("d >= 0").toArrow())
    held.unpersist()
    x = np.stack([sample.column(c).to_numpy() for c in "abcd"], 1) if sample.num_rows else np.zeros((0, USED))
    y = sample.column("label").to_numpy().astype(float) if sample.num_rows else np.zeros(0)
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order]
    if not len(y) or y.min() == y.max():
        return ToxicModel(prior)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    weight = np.where(y == 1, n[1] / y.sum(), n[0] / (1 - y).sum())
    w = logistic((x - centre) / scale, y, weight / weight.mean())
    return ToxicModel(prior, tables[0], rest if tables[0].partial else None, centre, scale, w, x.min(0), x.max(0))


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score``, ``log_ratio`` (of the text, per
    symbol), ``worst_ratio`` and ``worst_passage``, which replace columns of
    these names."""
    docs = docs.drop("score", "log_ratio", "worst_ratio", "worst_passage")
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(replace(model, rest=None))
    schema, added = docs.schema, None
    if model.rest is not None:
        added = free_name(docs, "_rest_words")
        docs = with_rest_words(docs, sc.broadcast({0: model.table}), model.rest, F.lit(0), added, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        own = held.value
        for batch in batches:
            for part in slices(batch, text_col):
                data = texts(part, text_col)
                rest = rest_words(part, added) if added else None
                kept = part.select(schema.names)
                x, mean, worst = features(own.table, data, cache, rest) if own.table is not None else (
                    np.full((len(data), USED), -1.0), np.zeros(len(data)), [""] * len(data))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(own.score(x)), pa.array(mean), pa.array(x[:, 0]),
                     pa.array(worst, pa.string())],
                    names=[*kept.schema.names, "score", "log_ratio", "worst_ratio", "worst_passage"])

    real = [T.StructField(c, T.DoubleType()) for c in ("score", "log_ratio", "worst_ratio")]
    return docs.mapInArrow(run, T.StructType([*schema.fields, *real, T.StructField("worst_passage", T.StringType())]))


def held_out(key: str = "doc_id") -> Column:
    """Rows kept for judging: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(quoted(key)).cast("string")) % 5 == 0, F.lit(False))


def learn_rows(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(quoted(key)).cast("string")) % 5 != 0, F.lit(False))
