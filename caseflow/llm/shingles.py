"""Word shingles of texts as sets of 64-bit hashes, vectorised."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MUL = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * MIX_1
    x = (x ^ x >> np.uint64(27)) * MIX_2
    return x ^ x >> np.uint64(31)


def shingle_sets(data: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The distinct shingles of ``k`` words of each text, ascending; a text
    with fewer words is one shingle, one without words has none.  Words are
    runs of characters other than ASCII white space, A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(data))
    words = lists.flatten().dictionary_encode()
    known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    codes = words.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    if "" in known:  # at white space at either end of a text
        real = codes != known.index("")
        offsets = np.r_[0, np.cumsum(real)][offsets]
        codes = codes[real]
    h = hashes[codes]
    run = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        run = run * MUL + h[i:i + len(run)]
    run = mixed(run)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            yield np.unique(run[a:b - k + 1])
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    value = value * MUL + x
            yield mixed(np.array([value]))
        else:
            yield run[:0]


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
