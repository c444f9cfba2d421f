"""Kneser-Ney toxicity against a plain model, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseflow.llm import toxicity as tx
from caseflow.llm.queries import QUERIES

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(label) - n1))


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    plain = ["river", "stone", "lamp", "winter", "garden", "paper", "cloud", "engine"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(plain) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(5, 60))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grobnik", "grobnake", "grobno"])
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(bad)))
    return rows, labels


# ---- the model, step by step -------------------------------------------------------

def plain_grams(word):
    s = [tx.EDGE] + tx.symbols(np.array([ord(c) for c in word])).tolist() + [tx.EDGE]
    for i in range(1, len(s)):
        yield tuple(([0] * tx.ORDER + s[:i + 1])[-tx.ORDER:])


def plain_ratios(toxic, ordinary):
    """Log ratio of any word, from two lists of words."""
    t, o = (Counter(g for w in ws for g in plain_grams(w)) for ws in (toxic, ordinary))
    counts = {tx.ORDER: t + o}
    for k in range(tx.ORDER - 1, 0, -1):
        counts[k] = Counter()
        for g, n in counts[k + 1].items():
            counts[k][g[1:]] += n if g[0] == 0 else 1

    def smoothed(g):
        if len(g) == 1:
            return (counts[1][g] + 1) / (sum(counts[1].values()) + 64)
        same = {x: n for x, n in counts[len(g)].items() if x[:-1] == g[:-1]}
        return (max(counts[len(g)][g] - tx.DISCOUNT, 0)
                + tx.DISCOUNT * len(same) * smoothed(g[1:])) / sum(same.values())

    def of_class(c, g, p):
        same = [n for x, n in c.items() if x[:-1] == g[:-1]]
        all_ = sum(same) + tx.STRENGTH
        return (max(c[g] - tx.DISCOUNT, 0) + (tx.DISCOUNT * len(same) + tx.STRENGTH) * p) / all_

    def ratio(word):
        total = 0.0
        for g in plain_grams(word):
            if g in counts[tx.ORDER]:
                p = smoothed(g)
            elif any(x[:-1] == g[:-1] for x in counts[tx.ORDER]):
                p = 1.0  # the shared estimate cancels
            else:
                continue
            total += math.log(of_class(t, g, p) / of_class(o, g, p))
        return total
    return ratio


def test_ratios_equal_plain_kneser_ney(spark):
    toxic, ordinary = "a grob grobnik! the grob Änne grobs".lower().split(), "the then a river rivers än the x9 then".split()
    rows = spark.createDataFrame([(" ".join(toxic[:4]), 1, 0), (" ".join(toxic[4:]), 1, 1),
                                  (" ".join(ordinary[:5]), 0, 0), (" ".join(ordinary[5:]), 0, 1)],
                                 "text string, label int, fold int")
    entries = tx.table_entries(tx.count_grams(rows))
    tables = tx._tables(entries, (0, 1, 2), 1 << 14)
    probe = toxic + ordinary + ["unseen", "grobnake", "riv", "zzz", "ä", "a" * 40]
    want = plain_ratios(toxic, ordinary)
    assert np.allclose(tables[0].ratios(probe), [want(w) for w in probe], atol=1e-5)
    want = plain_ratios(toxic[4:], ordinary[5:])  # model 1: without the texts of fold 0
    assert np.allclose(tables[1].ratios(probe), [want(w) for w in probe], atol=1e-5)


def test_words_of_slices():
    data = pa.array(["x", "  Two  words ", "", "É", "two"]).slice(1)
    codes, offsets, known = tx.words(data)
    got = [[known[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [["two", "words"], [], ["é"], ["two"]]
    g, of = tx.grams(["ab", "c"])
    assert of.tolist() == [0, 0, 0, 1, 1]
    assert [[x >> 6 * j & 63 for j in range(6)] for x in g.tolist()][2] == [tx.EDGE, 2, 1, tx.EDGE, 0, 0]


def test_slots_keep_the_frequent_one(spark):
    entries = spark.createDataFrame([(0, k, float(k), 100 - k) for k in range(100)], "model int, key long, value double, n long")
    table = tx._tables(entries, (0,), 16)[0]
    at = tx.slot(np.arange(100), 16)
    for s in range(16):
        own = np.flatnonzero(at == s)
        assert table.keys[s] == (own.min() if len(own) else -1)


def test_passages_and_whole_texts():
    table = tx.Table(np.full(16, -1, np.int64), np.zeros(16, np.float32))
    cache = {"bad": 6.0, "ok": -0.5}
    data = pa.array(["ok " * 500 + "bad " + "ok " * 500, "ok", "", "bad bad"])
    x, mean, worst = tx.features(table, data, cache)
    assert "bad" in worst[0].split() and len(worst[0].split()) == tx.PASSAGE
    assert x[0, 0] == pytest.approx((6 - 7 * 0.5) / (4 + 7 * 3)) and x[0, 1] == pytest.approx((6 - 4 * 0.5) / 5)
    assert mean[0] == pytest.approx((6 - 500) / (4 + 3000)) and x[2, 3] == -1 and x[3, 1] == 6
    assert x[3, 2] == pytest.approx(5) and worst[2] == ""


# ---- learning --------------------------------------------------------------------

def test_planted_words_in_held_out_texts(spark):
    rows, labels = corpus()
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    model = tx.learn(docs, lab, tx.learn_rows())
    got = {r.doc_id: r for r in tx.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30
    wrong = [i for i in held if (got[i].score >= 0.5) != (i % 4 == 0)]
    assert not wrong
    assert np.mean(["grob" in got[i].worst_passage for i in held if i % 4 == 0]) > 0.8


@pytest.mark.parametrize("slots, more", [(16, 1 << 21), (16, 40), (16, 0)])
def test_every_sequence_counts_whatever_the_bounds(spark, slots, more):
    rows, labels = corpus(120)
    rows += [(1000, None), (1001, ""), (None, "river grobnik"), (1003, "unseen grobnak 日本"), (1003, "unseen grobnak 日本")]
    docs = spark.createDataFrame([(*r, "y", 1) for r in rows], DOCS + ", model string, _digest int")
    lab = spark.createDataFrame(labels, LABELS)
    wide, own = tx.learn(docs, lab, tx.learn_rows()), tx.learn(docs, lab, tx.learn_rows(), slots=slots, more=more)
    assert wide.rest is None and (own.rest is not None) == (more < 1 << 21)
    assert own.weights == pytest.approx(wide.weights, abs=1e-9)
    a, b = (sorted(tx.score(docs, m).collect(), key=lambda r: (str(r.doc_id), r.text or "")) for m in (wide, own))
    assert len(a) == len(rows) and a[0].asDict().keys() == b[0].asDict().keys()
    for x, y in zip(a, b):
        assert (x.doc_id, x.text, x.model, x._digest) == (y.doc_id, y.text, y.model, y._digest)
        assert (y.score, y.log_ratio, y.worst_ratio) == pytest.approx((x.score, x.log_ratio, x.worst_ratio), abs=1e-9)


def test_entries_that_meet_in_a_slot_are_found(spark):
    entries = spark.createDataFrame([(0, k, k / 4, 100 - k) for k in range(100)], "model int, key long, value double, n long")
    table = tx._tables(entries, (0,), 16)[0]
    hit, value = table.find(np.arange(110))
    assert hit.tolist() == [True] * 100 + [False] * 10 and value[:100].tolist() == [k / 4 for k in range(100)]
    table = tx._tables(entries, (0,), 16, 30)[0]
    assert len(table.more_keys) == 30 and table.partial and table.find(np.arange(100))[0].sum() == 46


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (tx.learn(docs, spark.createDataFrame(x, LABELS), tx.learn_rows()) for x in (labels, turned))
    assert a.weights.tolist() == b.weights.tolist() and a.prior == b.prior
    assert (a.table.keys == b.table.keys).all() and (a.table.values == b.table.values).all()


def test_edge_rows(spark):
    rows, labels = corpus(120)
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (None, "river grobnik"), (1003, "lamp " * 200_000 + "grobnik grobnik"),
             (1004, "x"), (1004, "x"), (1005, "😀 日本 grobnik")]
    labels += [(None, 0, 1), (3, 0, None), (5, 0, 0), (5, 0, 0), (9999, 1, 1), (7, 1, 7)]
    docs = spark.createDataFrame([(*r, 0.25, "y", 1) for r in rows], DOCS + ", score double, label string, fold int")
    model = tx.learn(docs, spark.createDataFrame(labels, LABELS), tx.learn_rows())
    out = tx.score(docs.withColumn("held_out", tx.held_out()), model)
    assert out.columns[:2] == ["doc_id", "text"] and out.columns.count("score") == 1 and "label" in out.columns
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert {by[k].score for k in (1000, 1001, 1002)} == {model.prior} and by[None].held_out is False
    assert by[1003].score > by[1004].score and by[1000].worst_passage == ""
    assert len({r.score for r in got if r.doc_id == 1004}) == 1


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    ones = spark.createDataFrame([(i, 0, 1) for i in (1, 2)], LABELS)
    everything = F.lit(True)
    for labels, want in ((none, 0.0), (ones, 1.0)):
        model = tx.learn(docs, labels, everything)
        assert {r.score for r in tx.score(docs, model).collect()} == {want}
    both = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], LABELS)
    model = tx.learn(docs, both, everything)  # too little to calibrate: the share
    assert {r.score for r in tx.score(docs, model).collect()} == {0.5}
    empty = docs.where("doc_id > 5")
    assert tx.score(empty, tx.learn(empty, ones, everything)).count() == 0


def test_bitmap_keeps_every_id(spark):
    ids = spark.range(0, 50_000, 7).withColumnRenamed("id", "doc_id")
    rows = spark.range(50_000).withColumnRenamed("id", "doc_id")
    got = tx.with_ids_of(rows, ids)
    assert got.columns == ["doc_id"] and got.join(ids, "doc_id").count() == ids.count()
    assert got.count() < 1.02 * ids.count()


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op13_kneser_ney_toxicity"](spark, sf)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.toPandas()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out))
    held = rows[rows.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    hit = held.predicted == 1
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.95
    assert held[hit].toxic.mean() > 0.9 and hit[held.toxic == 1].mean() > 0.8
    assert defaultdict(int, held.toxic.value_counts())[1] > 50
