"""License scan by patience alignment of texts with license templates.

Words are runs of ASCII letters and digits, lower-cased.  A document is looked
at if the words it holds stand at ``COVERAGE`` of a template's places at least,
since no more can be aligned.  Its words that occur in the template form
clusters (gaps of up to ``GAP`` other words); a cluster for which the same
holds is aligned with the template: the words that occur once in both are
anchors, the longest increasing subsequence of their places is kept, and the
stretches between the anchors are aligned in the same way (equal words at
their ends first).  The share of the
template's words that are aligned is the coverage.  A cluster without an
anchor (it holds a notice twice) is cut into windows first; what lies before
and after a hit is looked at again, so a document has any number of hits.

Defined results: null and empty texts have no hits; spans are in code points,
the end exclusive; hits of one template do not overlap; repeated rows get equal
answers; further columns are kept, a column with the name of the result is
replaced.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caseflow.llm.common import slices, texts

COVERAGE = 0.75
GAP = 8

# License notices
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."),
    "apache-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies."),
}

HIT = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("matched", T.IntegerType()),
    T.StructField("words", T.IntegerType())]))
HIT_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                ("matched", pa.int32()), ("words", pa.int32())]))
WORD = re.compile("[a-z0-9]+")


def increasing(places: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, p in enumerate(places):
        k = bisect.bisect_left(tops, p)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            piles.append(i)
        else:
            tops[k], piles[k] = p, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word sequences, by patience alignment."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # equal ends need no anchor
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at_b]
        pairs = [pairs[k] for k in increasing([j for _, j in pairs])]
        found += pairs
        if pairs:
            ends = [(a0 - 1, b0 - 1), *pairs, (a1, b1)]
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:])]
    return sorted(found)


def hits(words: list[str], template: list[str], need: float = COVERAGE) -> list[tuple[int, int, int]]:
    """(first word, last word, aligned words) of the hits of one template."""
    known, least = Counter(template), need * len(template)
    places = [i for i, w in enumerate(words) if w in known]
    clusters, start = [], 0
    for k in range(1, len(places) + 1):
        if k == len(places) or places[k] - places[k - 1] > GAP:
            clusters.append((places[start], places[k - 1] + 1))
            start = k
    out = []
    while clusters:
        a, b = clusters.pop()
        if b - a < least or sum(known[w] for w in set(words[a:b])) < least:
            continue
        pairs = align(words[a:b], template)
        # aligned words far from their neighbours belong to other text
        runs, first = [], 0
        for k in range(1, len(pairs) + 1):
            if k == len(pairs) or pairs[k][0] - pairs[k - 1][0] > GAP + pairs[k][1] - pairs[k - 1][1]:
                runs.append(pairs[first:k])
                first = k
        best = max(runs, key=len, default=[])
        if len(best) >= least:
            x, y = a + best[0][0], a + best[-1][0] + 1
            out.append((x, y, len(best)))
            clusters += [(a, x), (y, b)]
        elif b - a > len(template):
            # more than one notice, or other text around: overlapping windows,
            # the first that is a hit decides where to go on
            size = len(template) + len(template) // 4 + 1
            for s in range(a, b, max(1, size // 4)):
                pairs = align(words[s:min(b, s + size)], template)
                if len(pairs) >= least:
                    x, y = s + pairs[0][0], s + pairs[-1][0] + 1
                    out.append((x, y, len(pairs)))
                    clusters.append((y, b))
                    break
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], need: float):
        self.need = need
        self.templates = {k: WORD.findall(v.lower()) for k, v in templates.items()}
        places = [Counter(v) for v in self.templates.values()]
        every = sorted(set().union(*places))
        self.every = pa.array(every)
        self.places = np.array([[c[w] for c in places] for w in every], float)
        self.least = np.array([need * len(v) for v in self.templates.values()])

    def candidates(self, data: pa.Array) -> np.ndarray:
        """Texts by templates: do the text's words stand at enough of the
        template's places?  (No alignment has more words than that.)"""
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(data), "[^a-z0-9]+", " "))
        words = lists.flatten().dictionary_encode()
        of_word = pc.fill_null(pc.index_in(words.dictionary, self.every), -1).to_numpy(zero_copy_only=False)
        code = of_word[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, int)
        doc = np.repeat(np.arange(len(data)), np.diff(lists.offsets.to_numpy()))
        pair = np.unique(doc[code >= 0].astype(np.int64) * len(self.every) + code[code >= 0])
        count = np.zeros((len(data), len(self.least)))
        np.add.at(count, pair // len(self.every), self.places[pair % len(self.every)])
        return count >= self.least

    def scan(self, data: pa.Array) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(data))]
        able = self.candidates(data)
        for i in np.flatnonzero(able.any(1)):
            spans = list(WORD.finditer(pc.ascii_lower(data[int(i)]).as_py()))
            words = [m[0] for m in spans]
            for k, (name, template) in enumerate(self.templates.items()):
                if able[i, k]:
                    out[i] += [{"license": name, "start": spans[a].start(), "end": spans[b - 1].end(),
                                "matched": n, "words": len(template)} for a, b, n in
                               hits(words, template, self.need)]
            out[i].sort(key=lambda h: (h["start"], h["license"]))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, need: float = COVERAGE,
         text_col: str = "text", out: str = "licenses") -> DataFrame:
    """All columns of ``docs`` and ``out``: array of (license, start, end,
    matched, words), by start and name."""
    docs = docs.drop(out)
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, need)
        for batch in batches:
            for part in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scanner.scan(texts(part, text_col)), HIT_ARROW)],
                    names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, HIT)]))
