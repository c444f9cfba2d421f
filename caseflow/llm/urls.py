"""URL rules in a sorted digest array.

The rules (action, host, path) become one file: their 64-bit xxhash keys in
ascending order, the offsets of the full strings, and the strings.  Executors
fetch the file through Spark (``addFile``), memory-map it, probe the keys of a
batch of URLs with one vectorised binary search and confirm every hit with the
stored string, so a collision of digests decides nothing.

A rule fits its host and all subdomains if the URL's path starts with the
rule's path; the longest rule that fits wins.  Without a rule the verdict is
``allow``: no listed key was found.

Defined results: null URLs and those without ``://`` have an empty host and
path and no rule; empty URLs likewise; repeated rows get equal answers; an
empty rule list allows all; of equal rules the last counts; further columns
are dropped but for those named.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def index_bytes(rules: list[tuple[str, str, str]]) -> bytes:
    """The file: number of rules, number of path lengths (u8 each), the path
    lengths (u8), keys (u8, ascending), string offsets (u8), actions (u1,
    1: block), strings (``host``, tab, ``path``)."""
    last = {f"{host}\t{path}".encode(): action for action, host, path in rules}
    rows = sorted((xxhash.xxh64_intdigest(k), k, a) for k, a in last.items())
    sizes = sorted({len(path) for _, _, path in rules})
    strings = [k for _, k, _ in rows]
    return b"".join([
        np.array([len(rows), len(sizes), *sizes, *(r[0] for r in rows)], "<u8").tobytes(),
        np.cumsum([0, *map(len, strings)]).astype("<u8").tobytes(),
        bytes(a == "block" for _, _, a in rows), *strings])


class DigestIndex:
    """Memory-mapped reader of that file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in raw[:16].view("<u8"))
        self.path_sizes = raw[16:16 + 8 * m].view("<u8").astype(int).tolist()
        at = 16 + 8 * m
        self.keys = raw[at:at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = raw[at:at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.block = raw[at:at + n]
        self.strings = raw[at + n:]

    def find(self, names: list[bytes]) -> np.ndarray:
        """Row of each name among the rules, or -1."""
        out = np.full(len(names), -1, np.int64)
        if not len(self.keys) or not names:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            row = int(at[i])
            while row < len(self.keys) and self.keys[row] == keys[i]:  # equal digests lie together
                if self.string(row) == names[i]:
                    out[i] = row
                    break
                row += 1
        return out

    def string(self, row: int) -> bytes:
        return self.strings[int(self.offsets[row]):int(self.offsets[row + 1])].tobytes()

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """The longest rule that fits each URL, and its verdict."""
        names, of, size = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            labels = host.split(".")
            for k in range(len(labels)):
                end = ".".join(labels[k:])
                for n in self.path_sizes:
                    if n <= len(path) and end:
                        names.append(f"{end}\t{path[:n]}".encode())
                        of.append(i)
                        size.append(len(end) + n)
        row = self.find(names)
        rule: list[str | None] = [None] * len(hosts)
        verdict, best = [DEFAULT] * len(hosts), [-1] * len(hosts)
        for j in np.flatnonzero(row >= 0):
            if size[j] > best[of[j]]:
                best[of[j]] = size[j]
                rule[of[j]] = self.string(int(row[j])).decode().replace("\t", "", 1)
                verdict[of[j]] = "block" if self.block[row[j]] else "allow"
        return rule, verdict


@lru_cache(maxsize=4)
def opened(name: str) -> DigestIndex:
    return DigestIndex(SparkFiles.get(name))


def publish(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Write the index to the shared folder and let executors fetch it."""
    uri = f"{scratch_path(spark, 'urls')}.index"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(index_bytes(rules)))
    out.close()
    spark.sparkContext.addFile(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return os.path.basename(uri)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url",
               keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The ``keep`` columns, host, path, rule (or null) and verdict."""
    name = publish(pages.sparkSession, rules)
    url = F.col(f"`{url_col}`").cast("string")
    parts = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(url).alias("host"), path_of(url).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = opened(name)
        for batch in batches:
            rule, verdict = index.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[*batch.schema.names, "rule", "verdict"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInArrow(run, f"{ddl}, rule string, verdict string")
