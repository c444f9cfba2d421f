"""Encoder, packing and token shards against the library and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import packing, repair
from caseflow.llm.encode import encoder
from caseflow.llm.packing import pack, packed, packing_plan, sum_of_squares
from caseflow.llm.queries import QUERIES, word_tokenizer
from caseflow.llm.repair import Shard, compress, read_documents, to_payload, write_shards

ODD = ["", " ", "It's THE end's 12,5% don't", "<|endoftext|> x<|startoftext|>", "<|ENDOFTEXT|>", "naïve CAFÉ—ok… e\u0301",
       "a\u2028b\x0bc\x1cd\x85e", "İstanbul ſ K", "x***y &&& '\"quoted'", "日本語 text 👍🏽!", "we'll I've they're 's's",
       "a\u00a0b", "word." * 50, "ÀÉ!ø?"]


def library(texts):
    return [encoder(word_tokenizer()).tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def own(texts):
    ids, sizes = encoder(word_tokenizer()).encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_encoder_on_odd_texts():
    assert own(ODD) == library(ODD)
    assert own(["", ""]) == [[], []]


def test_encoder_on_capitals_that_compose_in_lower_case_only():
    pairs = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    texts = pairs + [f"The {p}ABC,{p} End" for p in pairs] + ["J\u0323\u030c", "T\u0344", "E\u0301 I\u0307"]
    assert own(texts) == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ab.,'!é<|>\n0sS")), max_size=60),
                min_size=1, max_size=4))
def test_encoder_equals_library(texts):
    assert own(texts) == library(texts)


def test_encoder_table_is_emptied(monkeypatch):
    from caseflow.llm import encode

    monkeypatch.setattr(encode, "MAX_CHUNKS", 8)
    enc = encode.WordEncoder(word_tokenizer())
    for t in ("one two three four five", "five six seven eight nine", "one nine ten"):
        assert enc.encode(pa.array([t]))[0].tolist() == library([t])[0]


def test_sum_of_squares_rule():
    # 6 opens a bin (gap 4); a second 6 opens one; 4 fills the most crowded gap
    assert sorted(sum_of_squares([6, 6, 4], 10)) == [[6], [6, 4]]
    # filling gap 3 (two bins) lowers the sum most
    assert sorted(sum_of_squares([7, 7, 5, 3], 10)) == [[5], [7], [7, 3]]


@pytest.mark.parametrize("seed", range(4))
def test_packed_is_a_partition_and_tight(seed):
    r = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(99, r.lognormal(3, 1, 4000).astype(int) + 1), minlength=101)
    bins = packed(counts, 100)
    assert all(sum(b) <= 100 for b in bins)
    assert (np.bincount(np.concatenate(bins), minlength=101) == counts).all()
    assert len(bins) <= 1.01 * (counts * np.arange(101)).sum() / 100 + 1


def test_plan_of_many_pieces_is_whole(monkeypatch):
    monkeypatch.setattr(packing, "PROFILE", 200)
    r = np.random.default_rng(0)
    counts = np.zeros(65, np.int64)
    counts[1:64] = r.integers(0, 400, 63)
    levels = packing_plan(counts, 64)
    assert len(levels) > 2
    length = np.repeat(np.arange(65), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    seq, offset = packing.find_places(levels, length, rank)
    check_sequences(zip(seq.tolist(), offset.tolist(), length.tolist()), 64)
    assert len(set(seq.tolist())) <= 1.05 * (counts * np.arange(65)).sum() / 64


def check_sequences(places, capacity):
    by_seq = defaultdict(list)
    for seq, offset, length in places:
        by_seq[seq].append((offset, length))
    for rows in by_seq.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def rows_for(texts):
    return [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]


TEXTS = [None, "", " ", "short one", "short one", "word " * 700, "word " * 511 + "word", "longer text " * 3000] + \
        [f"text number {i} " * (i % 40) for i in range(120)]


def test_pack_edge_rows(spark):
    df = spark.createDataFrame(rows_for(TEXTS), "doc_id long, text string, `length` string, part long").repartition(3)
    got = pack(df, word_tokenizer(), capacity=256).collect()
    want = []
    for (i, t, _, _), ids in zip(rows_for(TEXTS), library([t or "" for t in TEXTS])):
        ids = np.array([*ids, 0], "<u4")
        want += [(i, a // 256, a, len(ids[a:a + 256]), zlib.crc32(ids[a:a + 256].tobytes()))
                 for a in range(0, len(ids), 256)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    n = check_sequences([(r.sequence_id, r.offset, r.length) for r in got], 256)
    assert n <= 1.03 * sum(r.length for r in got) / 256 + 1
    assert pack(df.limit(0), word_tokenizer()).collect() == []


def test_pack_query(spark):
    got = QUERIES["op1_sum_of_squares_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    ids = dict(zip([d.doc_id for d in docs], library([d.text for d in docs])))
    assert len({(r.doc_id, r.piece) for r in got}) == len(got)
    for r in got:
        x = np.array([*ids[r.doc_id], 0], "<u4")[r.start:r.start + r.length]
        assert len(x) == r.length and zlib.crc32(x.tobytes()) == r.ids_crc32 and r.start == 2048 * r.piece
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in ids.values())
    check_sequences([(r.sequence_id, r.offset, r.length) for r in got], 2048)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(1, 40), st.integers(2, 4))
def test_grammar_round_trip(ids, times, least):
    ids = np.array(ids * times, np.uint32)
    before = repair.MIN_COUNT
    try:
        repair.MIN_COUNT = least
        shard = Shard(to_payload(ids, np.zeros(1, np.int64)))
    finally:
        repair.MIN_COUNT = before
    assert (shard.ids() == ids).all() and (shard.document(0) == ids).all()
    r = random.Random(1)
    for _ in range(20):
        a, b = sorted(r.randint(0, len(ids)) for _ in range(2))
        assert (shard.ids(a, b) == ids[a:b]).all()


def test_late_passes_look_only_where_a_pair_can_be_frequent(monkeypatch):
    """The grammar of all places, from a look at a few of them."""
    from collections import Counter

    seen, disjoint = [], repair._disjoint

    def spy(*args):
        seen.append(len(args[-2]))  # ranks of the places looked at
        return disjoint(*args)

    monkeypatch.setattr(repair, "_disjoint", spy)
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.permutation(4000) + 100 if i % 2 else np.tile(np.arange(i % 6, i % 6 + 9), 8)
                          for i in range(40)]).astype(np.uint32)
    seq, rules, first = repair.compress(ids)
    assert max(seen[-2:]) < len(seq) / 10
    assert np.array_equal(Shard(to_payload(ids, np.array([0]))).ids(), ids)
    left = Counter(zip(seq[::2].tolist(), seq[1::2].tolist()))  # disjoint occurrences
    assert max(left.values()) < repair.MIN_COUNT


def test_words_go_to_the_library_in_parts(monkeypatch):
    from caseflow.llm import encode

    monkeypatch.setattr(encode, "WORDS_AT", 4)
    enc = encode.WordEncoder(word_tokenizer())
    most, own = [], enc._encode
    monkeypatch.setattr(enc, "_encode", lambda text: most.append(len(text.split())) or own(text))
    data = ["the quick brown fox jumps over the lazy dog", "", "seven words that no one wrote before"]
    ids, sizes = enc.encode(pa.array(data))
    assert 0 < max(most) <= 4
    want = [enc.tokenizer.encode(x, add_special_tokens=False).ids for x in data]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_a_worker_keeps_few_words():
    """More distinct words than are kept, in slices: the table stays small and
    the ids right."""
    from caseflow.llm import encode

    enc, letters = encode.WordEncoder(word_tokenizer()), "abcdefghij"
    for k in range(0, 450_000, 50_000):
        words = ["".join(letters[int(d)] for d in str(i)) for i in range(k, k + 50_000)]
        ids, sizes = enc.encode(pa.array([" ".join(words), words[-1]]))
        assert ids[-sizes[1]:].tolist() == enc.tokenizer.encode(words[-1], add_special_tokens=False).ids
    assert len(enc.index) <= 400_000


def test_grammar_compresses_and_stays_whole():
    r = np.random.default_rng(0)
    phrase = r.integers(0, 49408, 40)
    ids = np.concatenate([np.r_[phrase, r.integers(0, 49408, 5)] for _ in range(400)] + [np.full(1001, 7)]).astype(np.uint32)
    seq, rules, first = compress(ids)
    assert len(seq) < len(ids) / 4 and len(rules)
    assert (rules < (first + np.arange(len(rules)))[:, None]).all()
    assert (Shard(to_payload(ids, np.array([0]))).ids() == ids).all()


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(1)
    few = r.integers(0, 49408, 40_000).astype(np.uint32)
    few[np.arange(40) * 1000], few[np.arange(40) * 1000 + 1] = 3, 4  # less than 1 % of the ids
    many = np.tile(r.permutation(65_500)[:3000].astype(np.uint32), 20)
    many[0] = 65_530  # leaves five numbers of two bytes
    for ids in (few, many):
        seq, rules, first = compress(ids)
        pairs = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
        assert np.unique(pairs, return_counts=True)[1].max(initial=0) < repair.MIN_COUNT
        assert (Shard(to_payload(ids, np.array([0]))).ids() == ids).all()


def test_shards_edge_rows(spark, tmp_dir):
    df = spark.createDataFrame(rows_for(TEXTS), "doc_id long, text string, part string, shard long").repartition(4)
    write_shards(df, word_tokenizer(), f"{tmp_dir}/shards")
    got = sorted(map(tuple, read_documents(spark, f"{tmp_dir}/shards").collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted((r[0] for r in rows_for(TEXTS)), key=lambda d: (d is not None, d))
    at, want = 0, defaultdict(list)
    for (i, _, _, _), ids in zip(rows_for(TEXTS), library([t or "" for t in TEXTS])):
        ids = np.array([*ids, 2], "<u4")
        want[i].append((len(ids), zlib.crc32(ids.tobytes())))
    for i, start, n, crc in got:
        assert start == at
        want[i].remove((n, crc))
        at += n
    write_shards(df.limit(0), word_tokenizer(), f"{tmp_dir}/none")
    assert read_documents(spark, f"{tmp_dir}/none").collect() == []
    one = Shard(next(r.payload for r in spark.read.parquet(f"{tmp_dir}/shards").collect()))
    assert sum(len(one.document(k)) for k in range(len(one.doc_first))) == one.n_ids


def test_shards_query(spark):
    got = sorted(map(tuple, QUERIES["op2_re_pair_shards"](spark, "/root/testdata/sf0.001").collect()))
    docs = sorted((d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    at = 0
    for (i, start, n, crc), (d, _), ids in zip(got, docs, library([t for _, t in docs])):
        x = np.array([*ids, 2], "<u4")
        assert (i, start, n, crc) == (d, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert len(got) == len(docs)


class Task:
    """Stands for a DataFrame and keeps what a worker would run."""

    schema = None

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_later_stages_drop_the_encoder_of_a_worker(spark):
    from caseflow.llm.jaccard import sets_and_counts
    from caseflow.llm.packing import token_pieces
    from caseflow.llm.secret_scan import redact

    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": ["one two three four five six", "one two"]})
    pieces = token_pieces(Task(), word_tokenizer(), 8)
    for task in (sets_and_counts(Task(), 5), redact(Task())):
        list(pieces.run(iter([batch])))
        assert encoder.cache_info().currsize == 1  # for the next task of this stage
        assert len(list(task.run(iter([batch])))) > 0
        assert encoder.cache_info().currsize == 0
