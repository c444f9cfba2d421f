"""Language identification, SentencePiece models and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from caseflow.llm.langid import ByteNet, document_scores, held_out, identify, label_rows, learn, window_bytes, windows
from caseflow.llm.pieces import MARK, Model, build, codec, encode_pieces, parity
from caseflow.llm.queries import QUERIES, piece_model

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ---- language --------------------------------------------------------------------

def test_windows_hold_every_byte():
    data = pa.array(["", "ab", "é" * 300, "x" * 256, "y" * 257]).slice(1)
    raw, first, size, doc = windows(data)
    got = window_bytes(raw, first, size)
    for i, t in enumerate(data.to_pylist()):
        own = doc == i
        assert b"".join(g[:s].tobytes() for g, s in zip(got[own], size[own])) == t.encode()


def test_lookup_tables_equal_the_network():
    net = ByteNet(3)
    x = np.random.default_rng(0).integers(0, 256, (50, 256)).astype(np.uint8)
    pooled, _ = net._pooled(x)
    want = np.maximum(pooled, 0) @ net.p["out"] + net.p["bias"]
    assert np.allclose(net.scores(x), want, atol=1e-4)


def test_held_out_accuracy(spark):
    got = QUERIES["op8_byte_convolution_language"](spark, SF01)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(judged) > 200 and np.mean(judged) >= 0.97


def test_language_edge_rows(spark):
    rows = [(i, f"{w} " * 30, lang) for i in range(80) for w, lang in ((f"the and {i} thing", "en"), (f"der und {i} weiß", "de"))]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "en"), (None, "the and thing", None), (1003, "a", None),
           (1004, "der und weiß " * 50_000, "xx"), (1004, "der und weiß " * 50_000, "xx")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows + odd], "doc_id long, text string, lang string, score int, h string")
    langs, net = learn(df.where("lang is null or lang <> 'xx'"), label_rows())
    assert langs == ["de", "en"]
    got = {r.doc_id: r for r in identify(df.select("doc_id", "text", held_out().alias("held_out")), langs, net).collect()}
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[None].lang_pred == "en" and got[None].held_out is False and got[1004].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert learn(df.limit(0), label_rows()) == ([], None)
    unlabelled = identify(df.select("doc_id", "text"), [], None).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert identify(df.limit(0), langs, net).collect() == []


def test_every_language_is_a_class(spark):
    rows = [(i, f"word{i % 70} " * 9, f"l{i % 70:02}") for i in range(70 * 8)]
    langs, net = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), label_rows())
    assert langs == sorted({r[2] for r in rows}) and net.p["bias"].size == 70


def test_scores_of_nothing():
    assert document_scores(ByteNet(2), pa.array([], pa.string())).shape == (0, 2)


# ---- SentencePiece ------------------------------------------------------------------

ODD = ["", " ", "  Héllo   wörld\t\n 你好 ▁ x ", "a\x00b", "▁▁a b", "<s> </s> <0x41> <unk>", "😀 x,y;z. 'q'", "\n\n", "x▁y ▁ z",
       "Ａ ① ﬁ e\u0301", "word," * 40, "a  b   c    d     e"]


def test_parity_of_odd_texts():
    assert parity(piece_model(), ODD) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ab.,'▁é\n0")), max_size=50),
                min_size=1, max_size=4))
def test_parity(texts):
    assert parity(piece_model(), texts) == []


@pytest.mark.parametrize("kind", ["unigram", "bpe"])
def test_other_models(tmp_path, kind):
    """A model with extra-space removal and a character map, trained nowhere:
    built field by field for this test."""
    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, value):
        if isinstance(value, int):
            return varint(number * 8) + varint(value)
        if isinstance(value, float):
            return varint(number * 8 + 5) + np.float32(value).tobytes()
        return varint(number * 8 + 2) + varint(len(value)) + value

    letters = list("abcdef") + [MARK]
    more = ["ab", "abc", MARK + "a", MARK + "ab", "de", "def", "fa"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, -1.0 - k, 1) for k, p in enumerate(more)] + [(p, -20.0 - k, 1) for k, p in enumerate(letters)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    data += field(2, field(3, 1 if kind == "unigram" else 2) + field(35, 1))
    data += field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    path = tmp_path / f"{kind}.model"
    path.write_bytes(data)
    other = sentencepiece.SentencePieceProcessor(model_file=str(path))
    own = build(Model(data))
    r = random.Random(0)
    texts = ["", " ", "  abc  def ", "xyz é"] + ["".join(r.choice("abcdef  x") for _ in range(30)) for _ in range(100)]
    for t in texts:
        assert own.encode(t, add_special_tokens=False).ids == other.encode(t), t


def test_decoding():
    c = codec(piece_model())
    ids, sizes = c.encode(pa.array(ODD))
    parts = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert [b.decode() for b in c.decoded_bytes(ids, sizes)] == c.decode_batch(parts) == [t.replace(MARK, " ") for t in ODD]
    assert c.encode_batch(ODD) == parts


def test_piece_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "a b", 3), (3, "a b", 3), (None, "x " * 200_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    got = sorted((str(r.doc_id), r.n_pieces, r.round_trip, r.parity) for r in encode_pieces(df, piece_model(), verify_every=1).collect())
    assert [g[:2] for g in got[:4]] == [("1", 0), ("2", 0), ("3", 2), ("3", 2)] and all(g[2] and g[3] for g in got)
    assert encode_pieces(df.limit(0), piece_model()).collect() == []


def test_piece_query(spark):
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = QUERIES["op7_tokenizers_sentencepiece"](spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = other.encode(docs[r.doc_id])
        assert r.n_pieces == len(ids) and r.pieces_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.round_trip and r.parity is not False


def test_piece_query_checks_every_row(spark):
    got = QUERIES["op7_tokenizers_sentencepiece"](spark, SF001).collect()
    assert got and all(r.parity is True and r.round_trip for r in got)


def test_threads_stay_on(monkeypatch):
    import os

    from caseflow.llm import pieces

    class Docs:
        mapInArrow = staticmethod(lambda run, schema: run)

    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "false")
    monkeypatch.setenv("RAYON_NUM_THREADS", "1")
    monkeypatch.setattr(pieces, "id_text", lambda *a: Docs)
    codec.cache_clear()
    run = encode_pieces(None, piece_model(), threads=2)
    assert list(run([pa.record_batch({"doc_id": [1, 2], "text": ["a b", None]})]))
    assert parity(piece_model(), ["a b"], threads=2) == []
    assert os.environ["TOKENIZERS_PARALLELISM"] == "true"
    codec.cache_clear()


# ---- pipeline ---------------------------------------------------------------------------

def test_stages_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    known = corpus_pipeline.known_language(spark, docs, SF001)
    assert known.columns == docs.columns
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in known.select("doc_id").collect()}
    one = corpus_pipeline.one_of_each_group(spark, docs, SF001).select("doc_id").collect()
    groups = QUERIES["op5_jaccard_metric_join"](spark, SF001).collect()
    kept = {r.doc_id for r in one}
    for c in {g.component_id for g in groups}:
        assert len(kept & {g.doc_id for g in groups if g.component_id == c}) == 1
    assert len(one) == len(kept)
    out = corpus_pipeline.run(spark, SF001)
    assert {r.doc_id for r in out.collect()} == kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "n-gram jaccard join", "secret scan", "best-fit packing"]


def test_stages_edge_rows(spark, tmp_dir):
    en, de = "the and of that thing with word ", "der und das ist ein weiß wort "
    rows = [(i, (en if i % 2 else de) * 10 + f"number{i} " * 9, "en" if i % 2 else "de") for i in range(120)]
    rows += [(200, None, "en"), (201, "", None), (202, "1234 !!", "en"), (None, en * 40, None), (None, en * 40, "en"),
             (203, en * 3 + "password=abcdef99 " + de * 3, "en"), (203, en * 3 + "password=abcdef99 " + de * 3, "en")]
    df = spark.createDataFrame([(*r, None, 7, 1, "n", 2) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, score int, `a b` string, _row int")
    df.write.parquet(f"{tmp_dir}/docs")
    docs = spark.read.parquet(f"{tmp_dir}/docs")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if k < 3:
            assert stage(spark, docs.limit(0), tmp_dir).collect() == []
            out = stage(spark, docs, tmp_dir)
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_dir}/{k}")
            docs = spark.read.parquet(f"{tmp_dir}/{k}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if k == 0:
            assert not {200, 201, 202} & set(ids) and ids.count(None) == 2 and ids.count(203) == 2
        elif k == 1:
            assert ids.count(None) == 1 and ids.count(203) == 1
        elif k == 2:
            r = docs.where("doc_id = 203").first()
            assert "password" not in r.text and "[secret]" in r.text and r.n_chars == len(r.text)
    assert corpus_pipeline.packed(spark, docs, tmp_dir).where("doc_id = 203").count() == 1
    assert corpus_pipeline.packed(spark, docs.limit(0), tmp_dir).collect() == []


def test_row_numbers_stay_when_files_are_split_otherwise(spark, tmp_dir):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(30))) for i in range(40)]
    df = spark.createDataFrame([x for x in rows for _ in range(1 + x[0] % 2)], "doc_id long, text string")
    df.repartition(8, "doc_id").write.parquet(f"{tmp_dir}/docs")
    name, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(name, "64k")
        docs = spark.read.parquet(f"{tmp_dir}/docs")
        split = docs.rdd.getNumPartitions()
        one = corpus_pipeline.one_of_each_group(spark, docs, tmp_dir)
        spark.conf.set(name, old)
        assert spark.read.parquet(f"{tmp_dir}/docs").rdd.getNumPartitions() != split
        assert sorted(x.doc_id for x in one.collect()) == list(range(40))
    finally:
        spark.conf.set(name, old)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é▁ \x00😀日,.-'\n", max_size=30), min_size=1, max_size=6))
def test_decoding_by_parts_equals_the_library(items):
    c = codec(piece_model())
    data = pa.array(items, pa.string())
    ids, sizes = c.encode(data)
    runs = np.split(ids, np.cumsum(sizes)[:-1])
    assert c.decoded(data, ids, sizes) == c.decode_batch([x.tolist() for x in runs]) and c.by_parts


def test_a_part_that_decodes_otherwise_goes_to_the_library():
    from caseflow.llm.pieces import PieceCodec

    c = PieceCodec(piece_model())
    real = c.decode_batch
    c.decode_batch = lambda ids: [t + "!" for t in real(ids)]
    data = pa.array(["some words", "more"])
    ids, sizes = c.encode(data)
    assert not c.by_parts and c.decoded(data, ids, sizes) == ["some words!", "more!"]


def test_decoded_texts_come_from_the_ids():
    c = codec(piece_model())
    data, other = pa.array(["some words", "more"]), pa.array(["quite different", "x é 日"])
    ids, sizes = c.encode(other)
    assert c.decoded(data, ids, sizes) == other.to_pylist()  # not the texts themselves
    assert c.decoded(data[:0], ids[:0], sizes[:0]) == []


def test_a_wrong_id_shows_in_the_round_trip(monkeypatch):
    from caseflow.llm import pieces

    class Docs:
        mapInArrow = staticmethod(lambda run, schema: run)

    class Wrong(pieces.PieceCodec):
        def encode(self, texts):
            ids, sizes = super().encode(texts)
            return np.where(ids == ids[0], ids[-1], ids), sizes

    wrong = Wrong(piece_model())
    monkeypatch.setattr(pieces, "id_text", lambda *a: Docs)
    monkeypatch.setattr(pieces, "codec", lambda *a: wrong)
    out = list(encode_pieces(None, piece_model())([pa.record_batch({"doc_id": [1], "text": ["some other words"]})]))
    assert out[0].column("round_trip").to_pylist() == [False] and out[0].column("parity").to_pylist() == [False]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12), min_size=1, max_size=5))
def test_the_decoder_equals_that_of_the_tokenizer(ids):
    c = codec(piece_model())
    assert c.decoder is not c.tokenizer
    assert c.decode_batch(ids) == c.tokenizer.decode_batch(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab éÀÿ×÷▁▀с😀日,.-'\n!Z", max_size=14), max_size=6), st.integers(0, 2))
def test_parts_end_before_markers_and_signs(items, skipped):
    import re

    c = codec(piece_model())
    signs = re.escape("".join(chr(i) for i in np.flatnonzero(c.signs)))
    want = []
    for t in items[skipped:]:
        cut = re.sub(f"([^ {MARK}])([ {MARK}])", "\\1\x00\\2", " " + t)
        want.append(re.sub(f"([a-zA-ZÀ-ÖØ-öø-ÿ])([{signs}])", "\\1\x00\\2", cut).split("\x00") if t else [])
    assert c._split(pa.array(items, pa.string())[skipped:]).to_pylist() == want


def test_encoding_decodes_no_part(monkeypatch):
    from caseflow.llm.pieces import PieceCodec

    c = PieceCodec(piece_model())
    monkeypatch.setattr(c, "decode_batch", None)
    assert len(c.encode(pa.array(["some words", "more"]))[1]) == 2


def test_rows_of_files_are_numbered_without_a_copy(spark, tmp_dir):
    df = spark.createDataFrame([(i // 2, f"text {i}", i) for i in range(30)], "doc_id long, text string, _file int")
    df.repartition(3).write.parquet(f"{tmp_dir}/docs")
    docs = spark.read.parquet(f"{tmp_dir}/docs")
    rows = corpus_pipeline.numbered(spark, docs, "_row")
    assert set(docs.inputFiles()) <= set(rows.inputFiles())
    assert rows.columns == [*docs.columns, "_row"] and rows.select("_row").distinct().count() == rows.count() == 30
    # what is not exactly the rows of files is written
    for other, n in ((docs.limit(4), 4), (docs.where("doc_id < 5"), 10), (docs.union(docs), 60), (df, 30),
                     (docs.withColumn("doc_id", F.explode(F.array("doc_id", F.lit(None)))), 60), (docs.limit(0), 0)):
        rows = corpus_pipeline.numbered(spark, other, "_row")
        assert not set(docs.inputFiles()) & set(rows.inputFiles())
        assert rows.select("_row").distinct().count() == rows.count() == n
