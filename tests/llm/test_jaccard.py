"""Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from caseflow.llm.components import components
from caseflow.llm.jaccard import jaccard_join
from caseflow.llm.queries import QUERIES
from caseflow.llm.shingles import shingle_sets

UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))),
                  key=str)


def family_texts(seed):
    """Families of near copies, chains of them, shared passages, fillers."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passages = [[word() for _ in range(50)] for _ in range(4)]
    out = []
    for size, edits in ((60, 1), (40, 3), (25, 6), (5, 2)):
        base = [word() for _ in range(r.randint(60, 160))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, edits)):
                t[r.randrange(len(t))] = word()
            out.append(t)
            if r.random() < 0.3:
                base = t  # drift: a chain
    for _ in range(60):
        t = [word() for _ in range(r.randint(5, 40))]
        for p in r.sample(passages, r.randint(0, 3)):
            t += p
        out.append(t)
    out += [list(out[0]) for _ in range(30)] + [["the"] * 9, ["the"] * 40, ["a", "b"], ["A", "B"], []]
    r.shuffle(out)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("small,hot_count", [(3, 4), (8, 10 ** 9), (32, 16)])
def test_equals_brute_force(spark, monkeypatch, small, hot_count):
    from caseflow.llm import jaccard

    if small < 32:  # later rounds get pivots as well
        monkeypatch.setattr(jaccard, "LATER", 1)
    rows = list(enumerate(family_texts(small)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join(df, small=small, hot_count=hot_count).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_what_the_rounds_leave_is_joined(spark, monkeypatch):
    from caseflow.llm import jaccard

    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "LATER", 1)
    rows = [(i, t) for i, t in enumerate(family_texts(5)) if i % 2]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, jaccard_join(df, small=2, hot_count=4).collect()), key=str) == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, " ONE "), (None, "one"), (6, long), (7, long + " x"),
            (None, "only here in the whole table"), (8, "a b c d"), (9, "a b c d"), (9, "a b c d"), (10, "É a b c d"),
            (11, "é a b c d")]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, n string, comp long")
    assert sorted(map(tuple, jaccard_join(df).collect()), key=str) == brute(rows)
    assert jaccard_join(df.limit(0)).collect() == []


def test_shingle_sets():
    data = pa.array(["a b c d e f", " A  b c d e ", "x", "", "\x0b\x0c", "a b c"])
    own = list(shingle_sets(data))
    assert [len(s) for s in own] == [2, 1, 1, 0, 0, 1]
    assert own[1][0] in own[0]
    # not all rows of a buffer
    assert [len(s) for s in shingle_sets(data.slice(1, 2))] == [1, 1]


def test_components_of_chains_and_stars(spark):
    r = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 240)] + [(239, 1000)]
    edges += [tuple(map(int, e)) for e in r.integers(2000, 2400, (200, 2))]
    r.shuffle(edges)
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in edges:
        x, y = sorted((find(int(a)), find(int(b))))
        top[y] = x
    got = components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")).collect()
    want = {n: find(n) for n in top if any(n in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.comp for r in got} == want and len(got) == len(want)


def test_query(spark):
    got = QUERIES["op5_jaccard_metric_join"](spark, "/root/testdata/sf0.001")
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 3
    assert sorted(map(tuple, got.collect()), key=str) == brute(
        [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_sets_travel_as_compressed_texts():
    from caseflow.llm.jaccard import packed, unpacked

    r = random.Random(5)
    known = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    data = pa.array([" ".join(r.choices(known, k=400)), "One two\tTHREE four five six é", "again " * 5000, "x", " a b  "])
    sets = list(shingle_sets(data))
    items = [pa.py_buffer(packed(t.as_buffer(), s)) for t, s in zip(data, sets)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(unpacked(items, 5), sets))
    assert items[0].size < sets[0].nbytes / 2 and items[2].size == 8 + sets[2].nbytes
    assert unpacked([], 5) == []


def near_copies(n, seed=2):
    """Copies of one text with up to nine changed words each: most are similar
    to the text, few to all others."""
    import random
    r = random.Random(seed)
    base = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        t = list(base)
        for j in r.sample(range(400), r.randint(2, 9)):
            t[j] = f"x{i}_{j}"
        out.append(" ".join(t))
    return out


def test_a_large_family_takes_pairs_in_proportion(spark, monkeypatch):
    from caseflow.llm import jaccard

    rows, seen = list(enumerate(near_copies(500))), {}

    def counted(df, name):
        out = written(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    written = jaccard.written
    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(jaccard, "AT_ONCE", 100, raising=False)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(map(tuple, jaccard_join(df, small=2).collect()), key=str)
    assert sum(seen["pairs"]) + sum(seen.get("homes", [])) <= 10 * len(rows)  # pairs whose sets are read
    assert sum(seen["to-pivots"]) <= 2 * len(rows)
    assert got == brute(rows)


def test_a_set_goes_once_to_the_pairs_of_a_group(spark, monkeypatch):
    from caseflow.llm import jaccard

    groups = [(10 * g + i, 10 * g + j) for g in range(20) for i in range(8) for j in range(i)]
    star = [(1000 + i, 999) for i in range(1, 60)]
    monkeypatch.setattr(jaccard, "BLOCK", 30)
    pairs = spark.createDataFrame([(a, b, False) for a, b in groups + star], "a long, b long, exact boolean")
    got = jaccard.blocks(pairs).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(groups + star)
    sent = {(r.block, x) for r in got for x in (r.a, r.b)}
    assert len([1 for _, x in sent if x < 999]) == 20 * 8
    hub = [r.block for r in got if r.b == 999]
    assert len(set(hub)) > 1 and max(hub.count(x) for x in set(hub)) < 59


def test_bits_bound_the_difference_of_sets():
    from caseflow.llm.jaccard import BITS, parities

    r = np.random.default_rng(4)
    for n, m in ((1, 1), (50, 50), (400, 380), (3000, 2900)):
        both = r.integers(0, 2 ** 63, 5000).astype(np.uint64)
        x, y = np.unique(both[:n]), np.unique(both[n // 3:n // 3 + m])
        differ = int(np.bitwise_count(parities(x).view(np.uint64) ^ parities(y).view(np.uint64)).sum())
        assert len(parities(x)) == BITS // 64 and differ <= len(np.setxor1d(x, y))
        assert not (parities(x) ^ parities(x)).any()


def test_pipeline_stage_does_not_compare_connected_copies(spark, monkeypatch):
    import corpus_pipeline
    from caseflow.llm import jaccard

    groups, copies, seen = 15, 12, []
    rows = [(g * copies + i, " ".join([f"g{g}w{j}" for j in range(60)] + [f"copy{i}"]))
            for g in range(groups) for i in range(copies)]

    def counted(df, name):
        out = written(df, name)
        if name == "distances":
            seen.append(out.count())
        return out

    written = jaccard.written
    monkeypatch.setattr(jaccard, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = [r.text.split()[0] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    assert sorted(got) == sorted(f"g{g}w0" for g in range(groups))
    assert sum(seen) == groups * (copies - 1)  # of copies * (copies - 1) / 2 pairs each
