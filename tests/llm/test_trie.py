"""Prefix trie of conversations against a plain one."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from caseflow.llm import prefix_trie as pt
from caseflow.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(e[3], e[4]) for e in sorted(v)] for c, v in own.items()}
    seq = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    return trie(seq)


def trie(seq):
    members, children = defaultdict(list), defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=lambda k: -len(k)):
        m = members[k]
        leaves[k] = sum(leaves[q] for q in children[k]) or 1
        saved[k] = sum(saved[q] for q in children[k]) + ((len(m) - 1) * len(k[-1][1].encode()) if k else 0)
        ends = ",".join(str(c) for c in sorted(m) if len(seq[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def small_runs(monkeypatch):
    """Runs of a few turns, groups of two runs, blocks of three ids: every path."""
    monkeypatch.setattr(pt, "RUN_TURNS", 6)
    monkeypatch.setattr(pt, "FAN", 2)
    monkeypatch.setattr(pt, "BLOCK_IDS", 3)


def random_rows(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(-10, convs):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "é!", "", None, "long text"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_trie_across_shards(spark, small_runs, seed):
    rows = random_rows(seed)
    got = rows_of(pt.prefix_trie(pt.rebuilt(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute(rows)


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op11_ternary_prefix_trie"](spark, sf)
    assert rows_of(df) == brute(rows)
    assert df.dtypes == [(c, "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                                                 "n_leaves", "saved_tokens")] + [("ends_sha256", "string")]


def test_edge_rows(spark, small_runs):
    """Nulls, a null id, repeated rows and turns, thousands of copies, a long
    conversation, a text of a million bytes, extra columns with clashing names."""
    rows = [(None, 0, "user", "x"), (3, None, "user", "first"), (3, 1, None, None), (3, 1, None, None), (4, 2, "a", "b")]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(2)]
    rows += [(5000, t, "bot", str(t % 3)) for t in range(400)] + [(5001, 0, "user", "ä" * 500_000)]
    rows += [(5002, 0, "user", "ä" * 500_000)] * 2
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", key string, run int")
    assert rows_of(pt.prefix_trie(pt.rebuilt(df))) == brute(rows)


def test_empty_table(spark):
    assert pt.prefix_trie(pt.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0


def test_conversations_without_turns(spark):
    """Ids whose rebuilt sequence is empty are members of the root."""
    ids = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:8]
    rows = [(c, 0, "user", "gone") for c in ids]
    got = rows_of(pt.prefix_trie(pt.rebuilt(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute(rows) and len(got) == 1 and got[0][3] == len(ids) and got[0][5] == 1


def test_tree_is_balanced_and_keeps_its_links():
    order = list(pt.median_order(1023))
    assert sorted(order) == list(range(1023))
    tree = pt.TernaryTree()
    paths = {i: tree.insert([i, 7]) for i in order}
    deepest = 0
    for i in range(1023):
        at, steps = tree.middle[0], 1
        while tree.code[at] != i:
            at, steps = (tree.low if i < tree.code[at] else tree.high)[at], steps + 1
        assert [at, tree.middle[at]] == paths[i] and tree.parent[at] == 0
        deepest = max(deepest, steps)
    assert deepest == 10  # 2^10 - 1 siblings
    assert tree.insert([5, 7]) == paths[5]
