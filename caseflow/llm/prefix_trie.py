"""Prefix trie of conversations by ternary search trees over range shards.

A conversation is the sequence of its turns; a turn is known by the MD5 of its
role and text, 16 bytes, so a sequence is a binary value whose order is the
order of the trie.  Equal sequences become one row with their members (the ids
are hashed in sorted blocks, a block a row).  The distinct sequences are dealt
by range and cut into runs of at most ``RUN_TURNS`` turns.  In each run the
turns are numbered by a dictionary in their own order, and the sequences go,
the middle one first, into a ternary search tree, which stays balanced.  One
backward pass over its nodes adds up members, leaves and savings.

A run's nodes are final but for those on the paths of its first and its last
sequence, which neighbouring runs may share.  These boundary nodes are merged
in rounds, ``FAN`` consecutive runs in a task, until one group is left; each
round leaves only the two outer paths of a group.

Defined results: rows with a null conversation id belong to none; turns are
ordered by number (null first), equal numbers by the digest of role and text;
null role or text is empty; repeated rows are turns of their own.  A
conversation without turns is a member of the root only; without conversations
there is no node.  A conversation's turns travel as 24 bytes each in one row
(their texts never do), which bounds the memory of a task by its longest
conversation and ``RUN_TURNS``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import quoted, written
from caseflow.session import shuffle_partitions

RUN_TURNS = 1 << 18
BLOCK_IDS = 1 << 14
FAN = 64
ROOT = bytes(16)

NODE = ("key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string, run long")
# a boundary node: what is final below it, and whether the run's first or last path holds it
OPEN = ("run long, key binary, parent binary, depth long, size long, n_convs long, conv_id long, ends string, "
        "n_children long, n_leaves long, saved long, first boolean, last boolean")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """``conv_id`` and ``turns`` (struct of digest and bytes of text, in order):
    the first ``h`` turns of the conversation whose id is the next lower
    multiple of ``group``, then the own turns after the first ``h``; ``h`` is
    crc32 of the id modulo ``most``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("d"),
        F.octet_length(text).cast("long").alias("size"))
    own = written(rows.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "d", "size"))),
                    lambda x: F.struct(x["d"].alias("d"), x["size"].alias("size"))).alias("own")), "conversations")
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("own", 1, most - 1).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left")
    return both.select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), h), F.slice("own", 1, 0)),
        F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))).alias("turns"))


# ---- members of equal sequences ----------------------------------------------------

def distinct_sequences(convs: DataFrame) -> DataFrame:
    """``seq`` (digests in a row), ``sizes``, ``n`` members, the smallest
    ``conv_id`` and ``ends`` (SHA-256 of the ids, ascending, joined by commas)."""
    spark = convs.sparkSession
    n = shuffle_partitions(spark)
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), ""))
    rows = convs.select("conv_id", joined.alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = rows.withColumn("name", F.unhex(F.md5("seq")))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, seq, sizes = None, [], None, None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([",".join(map(str, ids))], pa.string()), pa.array([seq], pa.binary()),
                 pa.array([sizes], pa.list_(pa.int64()))], names=["name", "first", "n", "ids", "seq", "sizes"])

        for batch in batches:
            names, convs_ = batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()
            for i, (name, conv) in enumerate(zip(names, convs_)):
                if ids and (name != now or len(ids) == BLOCK_IDS):
                    yield out()
                    ids = []
                if not ids:
                    now, seq, sizes = name, batch.column("seq")[i].as_py(), batch.column("sizes")[i].as_py()
                ids.append(conv)
        if ids:
            yield out()

    blocks = (rows.repartitionByRange(n, "name", "conv_id").sortWithinPartitions("name", "conv_id")
              .mapInArrow(blocked, "name binary, first long, n long, ids string, seq binary, sizes array<long>"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = row = digest = None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([row["seq"]], pa.binary()), pa.array([row["sizes"]], pa.list_(pa.int64())),
                 pa.array([row["n"]], pa.int64()), pa.array([row["first"]], pa.int64()),
                 pa.array([digest.hexdigest()])], names=["seq", "sizes", "n", "conv_id", "ends"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["name"] != now:
                    if row:
                        yield out()
                    now, row, digest = r["name"], r, hashlib.sha256(r["ids"].encode())
                else:
                    row["n"] += r["n"]
                    digest.update(b"," + r["ids"].encode())
        if row:
            yield out()

    return written(blocks.repartition(n, "name").sortWithinPartitions("name", "first").mapInArrow(
        hashed, "seq binary, sizes array<long>, n long, conv_id long, ends string"), "sequences")


# ---- ternary search tree -----------------------------------------------------------

class TernaryTree:
    """Nodes in the order of their making (a parent comes before its children);
    node 0 is the root.  ``low`` and ``high`` lead to turns with smaller and
    larger codes at the same place, ``middle`` to the turn that follows."""

    def __init__(self):
        self.code, self.low, self.high, self.middle, self.parent = [-1], [0], [0], [0], [0]

    def insert(self, codes: list[int]) -> list[int]:
        """The path of a sequence, without the root."""
        path, above = [], 0
        code, low, high, middle = self.code, self.low, self.high, self.middle
        for c in codes:
            at, links, from_ = middle[above], middle, above
            while at and code[at] != c:
                links, from_ = (low, at) if c < code[at] else (high, at)
                at = links[at]
            if not at:
                at = links[from_] = len(code)
                code.append(c)
                low.append(0)
                high.append(0)
                middle.append(0)
                self.parent.append(above)
            path.append(at)
            above = at
        return path


def median_order(n: int) -> Iterator[int]:
    """0 to n-1, the middle of every range before its halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            todo += [(m + 1, b), (a, m)]


def key_of(parent: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(parent + digest, digest_size=16).digest()


def run_nodes(run: int, rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """Final nodes and boundary nodes of consecutive distinct sequences."""
    seqs = [np.frombuffer(r["seq"], "V16") for r in rows]
    flat = np.concatenate(seqs) if seqs else np.zeros(0, "V16")
    # a turn's code is its place among the digests of the run, in their own order
    known, codes = np.unique(flat.view(np.uint8).reshape(-1, 16).view(">u8").reshape(-1, 2), axis=0, return_inverse=True)
    digests = [x.astype(">u8").tobytes() for x in known]
    at = np.r_[0, np.cumsum([len(s) for s in seqs])]
    codes = codes.ravel().tolist()
    tree = TernaryTree()
    size, ends, own, paths = {0: 0}, {}, {}, {}
    for i in median_order(len(rows)):
        path = tree.insert(codes[at[i]:at[i + 1]])
        size.update(zip(path, rows[i]["sizes"]))
        last = path[-1] if path else 0
        ends[last], own[last] = rows[i]["ends"], (rows[i]["n"], rows[i]["conv_id"])
        if i in (0, len(rows) - 1):
            paths[i] = {0, *path}
    total = len(tree.code)
    keys, depth = [ROOT] * total, [0] * total
    for v in range(1, total):  # parents first
        keys[v] = key_of(keys[tree.parent[v]], digests[tree.code[v]])
        depth[v] = depth[tree.parent[v]] + 1
    members = [own[v][0] if v in own else 0 for v in range(total)]
    least = [own[v][1] if v in own else None for v in range(total)]
    children, leaves, saved = [0] * total, [0] * total, [0] * total
    first, last = paths[0], paths[len(rows) - 1]
    for v in range(total - 1, -1, -1):  # children first
        p, boundary = tree.parent[v], v in first or v in last
        if not boundary:
            leaves[v] = leaves[v] or 1
            saved[v] += (members[v] - 1) * size[v]
        if v:
            members[p] += members[v]
            least[p] = least[v] if least[p] is None else min(least[p], least[v])
            if not boundary:
                children[p] += 1
                leaves[p] += leaves[v]
                saved[p] += saved[v]
    final, open_ = [], []
    for v in range(total):
        p = tree.parent[v]
        row = {"run": run, "key": keys[v], "parent": keys[p], "depth": depth[v], "n_convs": members[v],
               "conv_id": least[v], "n_children": children[v], "n_leaves": leaves[v]}
        if v in first or v in last:
            open_.append(row | {"size": size[v], "ends": ends.get(v), "saved": saved[v], "first": v in first,
                                "last": v in last})
        else:
            known_parent = p not in first and p not in last
            final.append(row | {"parent_conv_id": least[p] if known_parent else None, "saved_tokens": saved[v],
                                "ends_sha256": ends.get(v, EMPTY)})
    return final, open_


EMPTY = hashlib.sha256(b"").hexdigest()


def merge_group(rows: list[dict], run: int, whole: bool) -> tuple[list[dict], list[dict]]:
    """Boundary nodes of consecutive runs as those of one run: equal nodes are
    added up; those that no run outside can hold (all, if ``whole``) are final."""
    outer_first, outer_last = min(r["run"] for r in rows), max(r["run"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        r = r | {"first": r["first"] and r["run"] == outer_first, "last": r["last"] and r["run"] == outer_last}
        if r["key"] not in nodes:
            nodes[r["key"]] = r
            continue
        n = nodes[r["key"]]
        for c in ("n_convs", "n_children", "n_leaves", "saved"):
            n[c] += r[c]
        n["conv_id"] = min(n["conv_id"], r["conv_id"])
        n["ends"] = n["ends"] or r["ends"]
        n["first"], n["last"] = n["first"] or r["first"], n["last"] or r["last"]
    final, open_ = [], []
    for n in sorted(nodes.values(), key=lambda n: -n["depth"]):
        n["run"] = run
        if not whole and (n["first"] or n["last"]):
            open_.append(n)
            continue
        n["n_leaves"] = n["n_leaves"] or 1
        n["saved"] += (n["n_convs"] - 1) * n["size"]
        if n["depth"]:
            p = nodes[n["parent"]]
            p["n_children"] += 1
            p["n_leaves"] += n["n_leaves"]
            p["saved"] += n["saved"]
        final.append({**{c: n[c] for c in ("run", "key", "parent", "depth", "n_convs", "conv_id", "n_children",
                                           "n_leaves")},
                      "parent_conv_id": None, "saved_tokens": n["saved"], "ends_sha256": n["ends"] or EMPTY})
    return final, open_


KINDS = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _names(ddl: str) -> dict[str, pa.DataType]:
    return {f.split()[0]: KINDS[f.split()[1]] for f in ddl.split(", ")}


# one output for both kinds of rows: nodes and boundary nodes (``open``)
MIXED = _names(NODE) | _names(OPEN) | {"open": pa.bool_()}
MIXED_DDL = ", ".join(f"{n} {next(k for k, t in KINDS.items() if t == v)}" for n, v in MIXED.items())


def _mixed(final: list[dict], open_: list[dict]) -> pa.Table:
    rows = [r | {"open": False} for r in final] + [r | {"open": True} for r in open_]
    return pa.table([pa.array([r.get(n) for r in rows], t) for n, t in MIXED.items()], names=list(MIXED))


def _merged(whole: bool) -> Callable[[pa.Table], pa.Table]:
    def merged(t: pa.Table) -> pa.Table:
        rows = t.drop_columns(["place", "batch"]).to_pylist()
        return _mixed(*merge_group(rows, t.column("batch")[0].as_py(), whole))

    return merged


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``convs`` (``conv_id``, ``turns``)."""
    spark = convs.sparkSession
    seqs = distinct_sequences(convs)
    run_turns = RUN_TURNS

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, turns = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if held and turns + len(r["sizes"]) > run_turns:
                    yield from _mixed(*run_nodes(run, held)).to_batches(max_chunksize=10_000)
                    run, held, turns = run + 1, [], 0
                held.append(r)
                turns += len(r["sizes"])
        if held:
            yield from _mixed(*run_nodes(run, held)).to_batches(max_chunksize=10_000)

    dealt = seqs.repartitionByRange(shuffle_partitions(spark), "seq").sortWithinPartitions("seq")
    nodes = written(dealt.mapInArrow(shards, MIXED_DDL), "trie-nodes")
    cols = [f.split()[0] for f in NODE.split(", ")]
    open_cols = [f.split()[0] for f in OPEN.split(", ")]
    inner = nodes.where("not open").select(*cols)
    edge = own_edge = nodes.where("open").select(*open_cols)
    done = []
    while True:
        # consecutive runs get consecutive numbers: at most one row per run is counted here
        runs = sorted(r[0] for r in edge.select("run").distinct().collect())
        if not runs:
            break
        number = F.broadcast(spark.createDataFrame(list(zip(runs, range(len(runs)))), "run long, place long"))
        whole = len(runs) <= FAN

        got = written(edge.join(number, "run").withColumn("batch", F.floor(F.col("place") / FAN).cast("long"))
                      .groupBy("batch").applyInArrow(_merged(whole), MIXED_DDL), "trie-boundary")
        done.append(got.where("not open").select(*cols))
        if whole:
            break
        edge = got.where("open").select(*open_cols)
    result = [c for c in cols if c not in ("key", "parent", "run")]
    if not done:
        return inner.select(*result)
    boundary = done[0]
    for d in done[1:]:
        boundary = boundary.unionByName(d)
    boundary = written(boundary, "trie-boundary")
    # a child of a boundary node learns its parent's smallest member from its own run's copy of that node
    of_run = own_edge.select("run", "key").join(boundary.select("key", F.col("conv_id").alias("of_parent")), "key")
    waiting = inner.where("parent_conv_id is null").join(
        of_run.select("run", F.col("key").alias("parent"), "of_parent"), ["run", "parent"])
    up = boundary.select(F.col("key").alias("parent"), F.col("conv_id").alias("of_parent"))
    inside = boundary.join(up, "parent").withColumn("of_parent", F.when(F.col("depth") > 0, F.col("of_parent")))
    shown = lambda df: df.select(*[F.col("of_parent").alias(c) if c == "parent_conv_id" else F.col(c) for c in result])
    return inner.where("parent_conv_id is not null").select(*result).unionByName(shown(waiting)).unionByName(shown(inside))
