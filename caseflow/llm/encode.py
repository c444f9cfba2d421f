"""Token ids of whole texts with the ``tokenizers`` library, vectorised.

The pre-tokenizer of the word BPE never joins characters across white space,
nor a letter with an ASCII sign that follows it, so a text's ids are the ids
of its chunks one after the other.  Each distinct chunk is encoded once by the
library; ids of a batch are gathered from a table of known chunks.  Texts that
hold the start of a special token (``<|``) are encoded as they stand.  Chunks
are lower-cased beforehand, but not in texts with a mark after a capital: the
library composes first, and some pairs compose in lower case only.  Tests
compare the result with the library's own encoding of the whole text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from caseflow.llm.common import KEPT

# Chunks kept per worker; the table is emptied beyond that (it is only a cache).
MAX_CHUNKS = 400_000
# Words given to the library at once; bounds what it holds on each token.
WORDS_AT = 1 << 14
_CAPITAL_MARK = r"[A-Z]\p{M}"
_LETTER_SIGN = r"([a-zA-ZÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"


class WordEncoder:
    """Cached encoder for a tokenizer file whose words end in ``</w>``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encode(self, text: str) -> np.ndarray:
        # the fast kind keeps no offsets
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of chunks by the library, and the order they come in."""
        plain = pc.match_substring_regex(pa.array(chunks, pa.string()),
                                         "^[a-zà-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        words, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids = np.concatenate([np.zeros(0, np.uint32), *(
            self._encode(" ".join([chunks[i] for i in words[k:k + WORDS_AT]])) for k in range(0, len(words), WORDS_AT))])
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words):  # not one word end per chunk: take them one by one
            words, rest, ids, ends = words[:0], np.arange(len(chunks)), ids[:0], ends[:0]
        sizes = np.diff(np.r_[-1, ends])
        others = [e.ids for e in self.tokenizer.encode_batch_fast(
            [chunks[i] for i in rest], add_special_tokens=False)]
        sizes = np.r_[sizes, [len(x) for x in others]].astype(np.int64)
        ids = np.r_[ids, np.array([i for x in others for i in x], np.uint32)].astype(np.uint32)
        return ids, sizes, np.r_[words, rest]

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Rows of new chunks in the table."""
        ids, sizes, order = self._ids_of(chunks)
        base, n = len(self.index), len(chunks)
        while base + n > len(self.start):
            self.start, self.length = (np.r_[x, np.zeros_like(x)] for x in (self.start, self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        self.pool[self.used:self.used + len(ids)] = ids
        self.start[base:base + n] = self.used + np.cumsum(sizes) - sizes
        self.length[base:base + n] = sizes
        self.used += len(ids)
        self.index.update(zip([chunks[i] for i in order], range(base, base + n)))
        rows = np.empty(n, np.int64)
        rows[order] = np.arange(base, base + n)
        return rows

    def _split(self, texts: pa.Array) -> pa.Array:
        """The chunks of each text."""
        marked = pc.match_substring_regex(texts, _CAPITAL_MARK)
        lower = pc.if_else(marked, texts, pc.ascii_lower(texts))
        return pc.ascii_split_whitespace(pc.replace_substring_regex(lower, _LETTER_SIGN, r"\1 \2"))

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Texts that cannot be cut into chunks."""
        return pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self._split(texts)
        words = lists.flatten()
        coded = words.dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.index) + len(chunks) > MAX_CHUNKS:
            self._empty()
        rows = np.fromiter(map(self.index.get, chunks, [-1] * len(chunks)), np.int64, len(chunks))
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self._learn([chunks[i] for i in new])
        rows = rows[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else rows[:0]
        sizes = self.length[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.arange(total) + np.repeat(self.start[rows] - ends + sizes, sizes)]
        offsets = lists.offsets.to_numpy().astype(np.int64)
        at = np.r_[0, ends][offsets - offsets[0]]
        return ids, np.diff(at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts one after the other, and the number of
        ids of each text.  ``texts`` holds no nulls."""
        special = self._whole(texts)
        if not special.any():
            return self._chunked(texts)
        whole = [self._encode(texts[int(i)].as_py()) for i in np.flatnonzero(special)]
        ids, sizes = self._chunked(pc.if_else(pa.array(special), "", texts))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i, x in zip(np.flatnonzero(special), whole):
            parts[i], sizes[i] = x, len(x)
        return np.concatenate(parts), sizes


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer file."""
    return WordEncoder(path)


KEPT["encoder"] = encoder.cache_clear
