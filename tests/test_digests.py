"""Sequence digests: merging, equality with texts, plans, very long cases."""

from __future__ import annotations

import random

import pytest
from conftest import SF001
from golden import SCHEMA, golden_log

import __spark_entry__ as E
from caseflow.operators import clean as cl
from caseflow.operators import digests as dg
from caseflow.operators import variants as vr


def _log(spark, cases: dict[str, str], hours: int = 1):
    rows = [(c, f"2024-01-{1 + i * hours // 24:02d} {i * hours % 24:02d}:00:00", a, None, i)
            for c, acts in cases.items() for i, a in enumerate(acts)]
    return cl.clean(spark.createDataFrame(rows, SCHEMA))


def naive(acts: list[int], k: int) -> int:
    return sum(a * pow(dg.BASES[k], i, dg.PRIMES[k]) for i, a in enumerate(acts)) % dg.PRIMES[k]


def test_primes():
    for p in dg.PRIMES:
        assert p < 2 ** 31 and all(p % d for d in range(2, int(p ** 0.5) + 1))


def test_power_of_every_number_of_digits(spark):
    at = [0, 1, 1023, 1024, 1025, 2 ** 20 - 1, 2 ** 20, 2 ** 20 + 7, 2 ** 30 + 5, 2 ** 40 - 1]
    df = spark.createDataFrame([(x,) for x in at], "i long")
    for k in range(4):
        got = [r[0] for r in df.select(dg._power(k, df["i"])).collect()]
        assert got == [pow(dg.BASES[k], x, dg.PRIMES[k]) for x in at]


def test_equal_digest_means_equal_sequence(spark):
    rng = random.Random(5)
    cases = {f"c{i}": "".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for i in range(300)}
    log = _log(spark, cases)
    for hours in (1, 3, 24, 10_000):  # slices cut the cases elsewhere, digests stay
        got = {r.case_id: (r.d1, r.d2, r.n_events) for r in
               dg.case_digests(log.drop("ts_slice"), hours).collect()}
        if hours == 1:
            first = got
        assert got == first
    by = {}
    for c, acts in cases.items():
        by.setdefault(first[c], set()).add(acts)
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(cases.values()))
    counts = {r.case_id: r.n_cases for r in vr.variant_counts(dg.case_digests(log)).collect()}
    values = list(cases.values())
    assert counts == {min(c for c in cases if cases[c] == a): values.count(a) for a in set(values)}


def test_pieces_merge_in_any_grouping(spark):
    """Two slices joined first, or all at once, or event by event in Python."""
    log = _log(spark, {"x": "abcabcaabbccabcbca" * 3}, hours=5)
    pieces = dg.slice_digests(log.drop("ts_slice"), 24)
    assert pieces.count() > 8
    whole = dg.combine_digests(pieces).first()
    from pyspark.sql import functions as F
    pairs = dg.combine_digests(pieces.withColumn("pair", F.floor(F.col("ts_slice") / 2)), ["case_id", "pair"])
    assert dg.combine_digests(pairs, order="pair").first() == whole
    code = {r.activity: (r.a, r.b) for r in log.select(
        "activity", F.xxhash64("activity").alias("a"), F.xxhash64("activity", F.lit(1)).alias("b")).distinct().collect()}
    for k in range(4):
        acts = [code[a][k // 2] % (dg.PRIMES[k] - 1) + 1 for a in "abcabcaabbccabcbca" * 3]
        assert whole[f"h{k}"] == naive(acts, k)


def test_ranks_without_text_equal_ranks_by_text(spark):
    rng = random.Random(9)
    cases = {f"c{i:03d}": "".join(rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 2, 3]))) for i in range(200)}
    cases |= {f"z{i}": "hot" for i in range(90)}
    log = _log(spark, cases)
    counts = vr.variant_counts(dg.case_digests(log))
    got = [(r.variant, r.n_cases, r.variant_rank) for r in
           vr.ranked_variants(counts, log).orderBy("variant_rank").collect()]
    texts = [" → ".join(a) for a in cases.values()]
    want = sorted({t: texts.count(t) for t in texts}.items(), key=lambda x: (-x[1], x[0]))
    assert got == [(t, n, i + 1) for i, (t, n) in enumerate(want)]
    top = vr.top_variants(counts, log, 4).orderBy("variant_rank").collect()
    assert [(r.variant, r.n_cases) for r in top] == want[:4]
    bucket = {r.case_id: r.variant_rank for r in vr.bucket_ranks(counts, log).collect()}
    assert sorted(x for x in bucket.values() if x) == list(range(1, min(50, len(want)) + 1))


def test_golden_and_empty(spark):
    counts = vr.variant_counts(dg.case_digests(golden_log(spark)))
    assert counts.count() == 4 and {r.n_cases for r in counts.collect()} == {1}
    empty = cl.clean(spark.createDataFrame([], SCHEMA))
    none = vr.variant_counts(dg.case_digests(empty))
    assert none.count() == 0 and vr.ranked_variants(none, empty).count() == 0
    cov = vr.variant_coverage(none).first()
    assert cov.n_variants == 0 and cov.top3_share_pct is None


def test_case_of_a_million_events(spark):
    """Slices of one hour; three cases, two of them equal but for the last event."""
    from pyspark.sql import functions as F
    n = 1_000_000
    base = spark.range(n).select(
        F.col("id").alias("event_seq"), F.when(F.col("id") % 7 == 3, "b").otherwise("a").alias("activity"),
        F.timestamp_seconds(F.col("id") * 40).cast("timestamp_ntz").alias("ts"))
    log = base.withColumn("case_id", F.explode(F.array(*[F.lit(c) for c in "xyz"]))).withColumn(
        "activity", F.when((F.col("case_id") == "z") & (F.col("event_seq") == n - 1), "b").otherwise(F.col("activity")))
    got = {r.case_id: (r.d1, r.d2, r.n_events) for r in dg.case_digests(log, 24).collect()}
    assert got["x"] == got["y"] and got["x"][2] == n and got["z"] != got["x"] and got["z"][2] == n


@pytest.mark.parametrize("name", ["var_coverage", "var_pareto"])
def test_no_list_and_no_text_in_a_shuffle(spark, name):
    """What counts variants moves ids, slices and numbers only: after the
    exchange of the log itself, no text but the case id and no list."""
    df = E.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "array_join" not in plan and "array_sort" not in plan
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    assert "variant#" not in logical


def test_exchange_columns_of_digests(spark):
    """Every exchange of the digests: the events with their activity go by case
    and slice once; pieces and sums have the case id as their only text."""
    log = golden_log(spark).drop("ts_slice")
    df = dg.case_digests(spark.createDataFrame(log.collect(), log.schema))  # without the exchange of cleaning
    seen, todo = [], [df._jdf.queryExecution().executedPlan().initialPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "Exchange":
            seen.append(p.schema().simpleString()[7:-1].split(","))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    types = [[c.split(":")[1] for c in cols] for cols in seen]
    assert types and all(t in ("string", "bigint", "timestamp_ntz") for row in types for t in row)
    assert sorted(row.count("string") for row in types)[0] == 1
    by_case = [cols for cols in seen if any(c.startswith("h0:") for c in cols)]
    assert by_case and all([c for c in cols if c.endswith(":string")] == ["case_id:string"] for cols in by_case)
