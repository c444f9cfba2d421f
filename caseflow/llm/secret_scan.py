"""Secret scan: keyword prefilter, anchored patterns, embedded checksums.

An Aho-Corasick automaton finds every keyword of every kind in one pass over
the text (ASCII letters lower-cased); a kind's pattern is tried only at the
places of its keywords.  Runs of hexadecimal digits have no keyword; their
prefilter is one linear pass for a run of ``HEX_RUN`` digits.  Kinds whose
tokens carry a checksum are reported only if it holds.

Kinds, in this order: ``assign`` (a password or key that is assigned),
``access`` (cloud access key), ``hex``; with a checksum ``github`` and ``npm``
(six base-62 digits of the CRC-32), ``age`` (Bech32 secret key) and ``xprv``
(Base58Check extended private key).

Defined results: null and empty texts have no spans; spans are in code points,
the end exclusive; within a kind they are leftmost and do not overlap; spans
of different kinds may; repeated rows get equal answers; further columns are
kept as they are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caseflow.llm.common import lean, slices, texts

# Kinds, keywords (lower case) and patterns
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "age": ("age-secret-key-1",),
    "xprv": ("xprv",),
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "github": re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "age": re.compile(r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![0-9A-Z])"),
    "xprv": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"),
}
KINDS = ("assign", "access", "hex", "github", "npm", "age", "xprv")
BASE_KINDS = KINDS[:3]
HEX_RUN = 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()),
                                 T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType())]))
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def base62_crc32(body: str) -> str:
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def bech32_valid(text: str) -> bool:
    text = text.lower()
    head, _, data = text.rpartition("1")
    values = [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + [BECH32.index(c) for c in data]
    check = 1
    for v in values:
        high, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            check ^= step if high >> i & 1 else 0
    return check == 1


def base58_valid(text: str) -> bool:
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    zeros = len(text) - len(text.lstrip("1"))
    raw = bytes(zeros) + value.to_bytes((value.bit_length() + 7) // 8, "big")
    return len(raw) > 4 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def valid(kind: str, m: re.Match) -> bool:
    """Length and checksum rules of a match."""
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind in ("github", "npm"):
        return base62_crc32(m[0][4:34]) == m[0][34:]
    return bech32_valid(m[0]) if kind == "age" else base58_valid(m[0])


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def find_spans(text: str, lowered: str, has_hex: bool) -> list[tuple[int, int, str]]:
    """(start, order of the kind, end) of all spans of one text."""
    spans, free = [], dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton().iter(lowered):
        start = last - size + 1
        if start >= free[kind] and (m := PATTERNS[kind].match(text, start)):
            free[kind] = m.end()
            if valid(kind, m):
                spans.append((start, KINDS.index(kind), m.end()))
    if has_hex:
        spans += [(m.start(), 2, m.end()) for m in PATTERNS["hex"].finditer(text)
                  if m.end() - m.start() >= HEX_RUN]
    return sorted(spans)


def batch_spans(data: pa.Array) -> list[list[tuple[int, int, str]]]:
    has_hex = pc.match_substring_regex(data, f"[0-9a-f]{{{HEX_RUN}}}").to_pylist()
    return [find_spans(t, low, h) for t, low, h in
            zip(data.to_pylist(), pc.ascii_lower(data).to_pylist(), has_hex)]


def scan(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """All columns of ``docs`` and ``out``: array of (kind, start, end), by
    start and then kind; it replaces a column of that name."""
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
                         for spans in batch_spans(texts(part, text_col))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, SPAN_ARROW)],
                                                 names=[*part.schema.names, out])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(out, SPAN)]))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark`` (spans that
    overlap by one); null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                data = part.column(text_col)
                new = data.to_pylist()
                for i, spans in enumerate(batch_spans(texts(part, text_col))):
                    if not spans:
                        continue
                    text, done, pieces = new[i], 0, []
                    for a, _, b in spans:
                        if a >= done:
                            pieces += [text[done:a], mark]
                        done = max(done, b)
                    new[i] = "".join([*pieces, text[done:]])
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, part.schema.field(at), pa.array(new, data.type))

    return docs.mapInArrow(lean(run), docs.schema)
