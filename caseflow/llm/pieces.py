"""SentencePiece models on the tokenizers library.

The model file is parsed as protobuf wire format (no generated classes): its
pieces with scores and types, the model type and the normaliser settings.  The
same tokenizer is then built from parts of the ``tokenizers`` library: the
stored character map, the space rules and the marker ``▁``; a Unigram model
with the scores, or a BPE model whose merges are all splits of a piece into two
pieces, ordered by the piece's score; byte fallback; and the decoder that
undoes it.  Batches are encoded with the library's threads.

Where no piece joins a marker to a character before it (checked on loading),
ids of a text are the ids of its parts between such places, and each distinct
part is encoded once.  ``parity`` compares with the sentencepiece library.

Defined results: null text is the empty text, without ids; texts that hold the
internal separator are encoded as they stand; repeated rows get equal answers;
further columns are ignored.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from caseflow.llm.common import id_text, slices, texts
from caseflow.llm.encode import WordEncoder

MARK = "▁"
SEPARATOR = "\x00"
# Piece types and model types of the file format
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at:at + size]
            at += size


class Model:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict = {}
        normaliser: dict = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.char_map = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.remove_extra = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        self.byte_fallback = BYTE in self.types
        self.unk = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)

    def merges(self) -> list[tuple[str, str]]:
        ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER, UNUSED)}
        found = [(-self.scores[i], ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, i in ids.items()
                 for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        return [m[3:] for m in sorted(found)]

    def separable(self) -> bool:
        """No piece has a marker after another character, and the normaliser
        looks at no more than spaces."""
        return not self.char_map and not self.remove_extra and self.escape and self.kind == BPE and not any(
            MARK in p.lstrip(MARK) for p in self.pieces)


def build(model: Model, whole: bool = True):
    """The tokenizer; with ``whole`` it adds the first marker itself."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores)), model.unk, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, p in enumerate(model.pieces)}, model.merges(),
                          unk_token=model.pieces[model.unk], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind}: only unigram and BPE models")
    out = Tokenizer(core)
    steps = []
    if model.char_map:
        steps.append(normalizers.Precompiled(model.char_map))
    if model.remove_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix and whole:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " ")] + [decoders.ByteFallback()] * model.byte_fallback + [decoders.Fuse()]
        + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return out


def build_decoder(model: Model):
    """A tokenizer that only decodes, as that of ``build`` does: its vocabulary
    holds spaces for the markers, so the library need not look for them in every
    piece.  None where two pieces differ in that only."""
    from tokenizers import Tokenizer, decoders, models

    spaced = {p.replace(MARK, " "): i for i, p in enumerate(model.pieces)}
    if len(spaced) < len(model.pieces):
        return None
    out = Tokenizer(models.WordLevel(spaced, unk_token=model.pieces[model.unk]))
    out.decoder = decoders.Sequence([decoders.ByteFallback()] * model.byte_fallback + [decoders.Fuse()]
                                    + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return out


class PieceCodec(WordEncoder):
    """Encoder and decoder of a model file."""

    def __init__(self, path: str, threads: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.tokenizer = build(self.model)
        self.parts = build(self.model, whole=False)
        self.decoder = build_decoder(self.model) or self.tokenizer
        self.separable = self.model.separable()
        # ASCII signs that follow a letter in no piece: a part can end before them
        inner = {p[k:k + 2] for p in self.model.pieces for k in range(len(p) - 1)}
        after = {x[1] for x in inner if x[0].isalpha()}
        self.signs = np.isin(np.arange(256), [ord(c) for c in string.punctuation if c not in after])
        # letters before them: a-z in either case, and À to ÿ but × and ÷ by the second of their two bytes
        self.letters = np.isin(np.arange(256), list(string.ascii_letters.encode()))
        self.second = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])
        # bytes of every piece, for decoding by lookup
        raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else
               p.replace(MARK, " ").encode() for p, t in zip(self.model.pieces, self.model.types)]
        self.piece_size = np.array([len(x) for x in raw], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.is_byte = np.array(self.model.types) == BYTE
        self.lead = next(i for i, (x, t) in enumerate(zip(self.model.pieces, self.model.types))
                         if t == NORMAL and x.isalnum())
        self._empty()

    def _ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts that are new."""
        ids = [e.ids for e in self.parts.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes, np.arange(len(chunks))

    @property
    def by_parts(self) -> bool:
        """Whether the library decodes every part in the table to itself, after
        another piece (at the start it would drop a space)."""
        lead = self.model.pieces[self.lead]
        ids = (self.pool[self.start[i]:self.start[i] + self.length[i]].tolist() for i in self.index.values())
        told = self.decode_batch([[self.lead, *x] for x in ids])
        return all(lead + x.replace(MARK, " ") == t for x, t in zip(self.index, told))

    def _split(self, texts: pa.Array) -> pa.Array:
        """The parts of each text, cut where a marker follows another character
        or one of the signs a letter.  The bytes are only looked at, not copied."""
        texts = texts.cast(pa.string())
        if self.model.dummy_prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(
            texts) else np.zeros(1, np.int32)
        raw = texts.buffers()[2] or pa.py_buffer(b"")
        data = np.frombuffer(raw, np.uint8)[starts[0]:starts[-1]]
        at = starts - starts[0]
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            first = data == ord(" ")  # the first byte of a marker, and its last
            last = first.copy()
            a, b, c = MARK.encode()
            mark = np.flatnonzero(data == b)
            mark = mark[(mark > 0) & (mark < len(data) - 1)]
            mark = mark[(data[mark - 1] == a) & (data[mark + 1] == c)]
            first[mark - 1] = last[mark + 1] = True
            cut[1:-1] = first[1:] & ~last[:-1]
            sign = np.flatnonzero(self.signs[data])
            sign = sign[sign > 0]
            one, two = data[sign - 1], data[sign - 2]
            cut[sign[self.letters[one] | ((two == 0xC3) & self.second[one])]] = True
            cut[at[:-1]] = True  # that of an empty text is the next one's start
        places = np.flatnonzero(cut[:-1])
        parts = pa.StringArray.from_buffers(
            len(places), pa.py_buffer(np.append(places, len(data)).astype(np.int32) + starts[0]), raw)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(places, at), pa.int32()), parts)

    def _whole(self, texts: pa.Array) -> np.ndarray:
        if not self.separable:
            return np.ones(len(texts), bool)
        return pc.match_substring(texts, SEPARATOR).to_numpy(zero_copy_only=False)

    def encode_batch(self, items: list[str]) -> list[list[int]]:
        """Ids by the library alone, with its threads."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        """Texts by the library, one call each: its batch call takes twice the CPU."""
        return [self.decoder.decode(x, skip_special_tokens=False) for x in ids]

    def decoded(self, texts: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """What the library decodes all ids of each text to, from the ids alone."""
        if not len(texts):
            return []
        return self.decode_batch([x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])])

    def decoded_bytes(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts of consecutive runs of ids, by look-up (equal to
        the library's decoder where byte pieces form whole characters)."""
        n = self.piece_size[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.piece_bytes[np.arange(total) + np.repeat(self.piece_start[ids] - ends + n, n)].tobytes()
        at = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
        out = [raw[a:b] for a, b in zip(at[:-1], at[1:])]
        return [x.removeprefix(b" ") for x in out] if self.model.dummy_prefix else out


@lru_cache(maxsize=2)
def codec(path: str, threads: int = 1) -> PieceCodec:
    return PieceCodec(path, threads)


@lru_cache(maxsize=2)
def reference(path: str):
    """The sentencepiece library's own processor."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def differing(path: str, own: list[list[int]], back: list[str], items: list[str], threads: int = 1) -> list[int]:
    """Places of the texts for which the ids ``own`` or their decoded text
    ``back`` are not those of sentencepiece."""
    theirs = reference(path).encode(items, num_threads=threads)
    told = reference(path).decode(theirs, num_threads=1) if items else []  # threads cost more than they save
    return [i for i, (a, b, t, u) in enumerate(zip(own, theirs, back, told)) if a != b or t != u]


def parity(path: str, items: list[str], threads: int = 1) -> list[int]:
    """Places of the texts whose ids or decoded text differ from sentencepiece."""
    c = codec(path, threads)
    ids, sizes = c.encode(pa.array(items, pa.string()))
    own = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if items else []
    return differing(path, own, c.decode_batch(own), items, threads)


def encode_pieces(docs: DataFrame, model_path: str, threads: int = 1, id_col: str = "doc_id",
                  text_col: str = "text", verify_every: int = 1) -> DataFrame:
    """doc_id, n_pieces, pieces_crc32 (of the ids as little-endian u4), bytes
    that came from byte fallback, whether the ids decoded by the library give
    the text again, and ``parity``: whether ids and decoded text agree with
    sentencepiece (with ``verify_every`` above 1, of every so many rows of a
    batch only, and null for the others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path, threads)
        for batch in batches:
            for part in slices(batch):
                data = texts(part)
                ids, sizes = c.encode(data)
                own = np.split(ids, np.cumsum(sizes)[:-1])
                items = data.to_pylist()
                lists = [x.tolist() for x in own]
                back = c.decode_batch(lists)
                checked = list(range(0, len(items), verify_every))
                wrong = {checked[i] for i in differing(
                    model_path, *([x[i] for i in checked] for x in (lists, back, items)), threads)}
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(sizes),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    pa.array([int(c.is_byte[x].sum()) for x in own], pa.int64()),
                    pa.array([b == t.replace(MARK, " ") for b, t in zip(back, items)]),
                    pa.array([i not in wrong if i % verify_every == 0 else None for i in range(len(items))],
                             pa.bool_())],
                    names=["doc_id", "n_pieces", "pieces_crc32", "n_bytes", "round_trip", "parity"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_pieces long, pieces_crc32 long, n_bytes long, round_trip boolean, parity boolean")
