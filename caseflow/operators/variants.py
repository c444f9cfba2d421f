"""Process variants (DSC-1..6, WIN-4..6, JN-2/3).

The variant of a case is its ordered activity list joined by ' → '.  Variants
are counted, ranked and joined by digest (``operators.digests``): two numbers
and a length.  The text is built for one case of a variant only, and only
where it is asked for or decides: by the sinks, and among variants with equally
many cases, which rank by text.  Building it takes two levels: each (case, time
slice) sorts only its own events, then the case puts its slices together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.classify import rank_bucket, rank_bucket_order
from caseflow.functions.text import short_text
from caseflow.model import RANK_BUCKETS, VARIANT_SEPARATOR
from caseflow.operators.digests import KEY
from caseflow.operators.ranking import positions
from caseflow.operators.sequence import with_slice
from caseflow.operators.util import share_of_all
from caseflow.schema import ACTIVITY, CASE, SEQ, SLICE, TS


def case_variants(log: DataFrame, slice_hours: int = 24,
                  separator: str = VARIANT_SEPARATOR) -> DataFrame:
    """DSC-1: ``case_id, variant`` (one row per case)."""
    log = with_slice(log, slice_hours)
    ev = F.struct(F.col(TS).alias("ts"), F.col(SEQ).alias("seq"),
                  F.col(ACTIVITY).alias("activity"))
    pieces = (log.groupBy(CASE, SLICE)
              .agg(F.array_sort(F.collect_list(ev)).alias("_evs"))
              .select(CASE, F.struct(F.col(SLICE).alias("s"),
                                     F.transform("_evs", lambda e: e["activity"]).alias("a"))
                      .alias("_piece")))
    return (pieces.groupBy(CASE)
            .agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
            .select(CASE, F.array_join(F.flatten(F.transform("_pieces", lambda p: p["a"])),
                                       separator).alias("variant")))


def variant_counts(digests: DataFrame) -> DataFrame:
    """DSC-2: ``d1, d2, n_events, n_cases`` and ``case_id``, the smallest case
    of the variant, from :func:`case_digests` (map-side combined; hot variants
    are fine).  A table of :func:`case_variants` is counted by its texts:
    ``variant, n_cases``."""
    if "variant" in digests.columns:
        return digests.groupBy("variant").agg(F.count(F.lit(1)).alias("n_cases"))
    return digests.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_cases"), F.min(CASE).alias(CASE))


def variant_texts(log: DataFrame, counts: DataFrame, slice_hours: int = 24) -> DataFrame:
    """``counts`` with ``variant``, built from each variant's smallest case."""
    chosen = log.join(counts.select(CASE), CASE, "left_semi")
    return counts.join(case_variants(chosen, slice_hours), CASE)


def _classes(counts: DataFrame) -> DataFrame:
    """Variants by number of cases, with the variants that come before and how
    many of those share their number of cases with others.  The numbers of
    cases that occur are few: k of them need k * k / 2 cases."""
    per = counts.groupBy("n_cases").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(F.desc("n_cases")).rowsBetween(Window.unboundedPreceding, -1)
    tied = F.when(F.col("_size") > 1, F.col("_size")).otherwise(0)
    return per.select("n_cases", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
                      F.coalesce(F.sum(tied).over(before), F.lit(0)).alias("_tied_before"))


def variant_ranks(counts: DataFrame, log: DataFrame | None = None, slice_hours: int = 24) -> DataFrame:
    """WIN-4: ``counts`` with ``variant_rank`` -- 1 = most frequent, consecutive
    positions, ties by variant text ascending -- and without a text: that of
    variants with a number of cases of their own is never built, that of the
    others is sorted with nothing but its case.  Counts that have their texts
    already are ranked by them and need no log."""
    if "variant" in counts.columns:
        return positions(counts, [F.desc("n_cases"), F.asc("variant")], name="variant_rank")
    classed = counts.join(_classes(counts), "n_cases")
    alone = classed.where("_size = 1").select(CASE, (F.col("_before") + 1).cast("long").alias("variant_rank"))
    tied = classed.where("_size > 1").select(CASE, "n_cases", (F.col("_before") - F.col("_tied_before")).alias("_unique"))
    placed = positions(variant_texts(log, tied, slice_hours), [F.desc("n_cases"), F.asc("variant")], name="_pos")
    ranks = alone.unionByName(placed.select(CASE, (F.col("_unique") + F.col("_pos")).alias("variant_rank")))
    return counts.join(ranks, CASE)


def ranked_variants(counts: DataFrame, log: DataFrame, slice_hours: int = 24) -> DataFrame:
    """``variant, n_cases, variant_rank`` for the sink: every text once."""
    return variant_texts(log, variant_ranks(counts, log, slice_hours), slice_hours).select(
        "variant", "n_cases", "variant_rank")


def first_variants(counts: DataFrame, log: DataFrame, k: int, slice_hours: int = 24) -> DataFrame:
    """The ``k`` first variants with rank and text.  Texts are built for the
    variants whose number of cases is among the ``k`` largest only."""
    least = counts.orderBy(F.desc("n_cases")).limit(k).agg(F.min("n_cases").alias("_least"))
    near = counts.crossJoin(F.broadcast(least)).where("n_cases >= _least").drop("_least")
    top = (variant_texts(log, near, slice_hours).orderBy(F.desc("n_cases"), F.asc("variant")).limit(k))
    w = Window.orderBy(F.desc("n_cases"), F.asc("variant"))  # over k rows
    return top.withColumn("variant_rank", F.row_number().over(w).cast("long"))


def attach_variants(cases: DataFrame, digests: DataFrame, ranks: DataFrame) -> DataFrame:
    """JN-2/JN-3 and WIN-5: variant (if ``ranks`` has it), rank and top-3/top-10
    flags per case.

    Ranks are joined by digest; adaptive execution splits the partition of a
    hot variant."""
    text = ["variant"] if "variant" in ranks.columns else []
    known = digests.join(ranks.select(*KEY, "variant_rank", *text), KEY, "left").select(CASE, *text, "variant_rank")
    out = cases.join(known, CASE, "left")
    out = (out.withColumn("is_top3_variant", (F.col("variant_rank") <= 3).cast("int"))
              .withColumn("is_top10_variant", (F.col("variant_rank") <= 10).cast("int")))
    out = out.fillna(0, subset=["is_top3_variant", "is_top10_variant"])
    # the case key stays first
    return out.select(*cases.columns, *text, "variant_rank", "is_top3_variant", "is_top10_variant")


def activity_frequency(log: DataFrame, k: int | None = None) -> DataFrame:
    """DSC-3: events per activity and share of all events; with ``k`` the k
    most frequent ones, ties by name, with their rank."""
    per = log.groupBy(ACTIVITY).agg(F.count(F.lit(1)).alias("n_events"))
    out = share_of_all(per, ACTIVITY, "n_events")
    if k is None:
        return out
    w = Window.orderBy(F.desc("n_events"), F.asc(ACTIVITY))  # over k rows
    return (out.orderBy(F.desc("n_events"), F.asc(ACTIVITY)).limit(k)
            .withColumn("activity_rank", F.row_number().over(w).cast("long")))


def _largest(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest numbers of cases (TakeOrderedAndProject: k rows per
    task, then k); which of equal ones does not matter."""
    return counts.select("n_cases").orderBy(F.desc("n_cases")).limit(k)


def variant_coverage(counts: DataFrame) -> DataFrame:
    """DSC-4: number of variants and cases, share of the top 3 / top 10."""
    tot = counts.agg(F.count(F.lit(1)).alias("n_variants"),
                     F.sum("n_cases").cast("long").alias("n_cases"))
    w = Window.orderBy(F.desc("n_cases"))  # over 10 rows
    top = _largest(counts, 10).withColumn("_r", F.row_number().over(w)).agg(
        F.sum(F.when(F.col("_r") <= 3, F.col("n_cases"))).alias("_t3"), F.sum("n_cases").alias("_t10"))
    return (F.broadcast(tot).crossJoin(F.broadcast(top))
            .select("n_variants", "n_cases",
                    (F.col("_t3") / F.col("n_cases") * 100).alias("top3_share_pct"),
                    (F.col("_t10") / F.col("n_cases") * 100).alias("top10_share_pct"),
                    (100 - F.col("_t3") / F.col("n_cases") * 100).alias("tail_share_pct")))


def top_variants(counts: DataFrame, log: DataFrame, k: int = 5, slice_hours: int = 24) -> DataFrame:
    """DSC-5: the k most frequent variants with rank, share and short text."""
    tot = counts.agg(F.sum("n_cases").alias("_tot"))
    return (first_variants(counts, log, k, slice_hours).crossJoin(F.broadcast(tot))
            .select("variant_rank", "variant", "n_cases",
                    (F.col("n_cases") / F.col("_tot") * 100).alias("share_pct"),
                    short_text("variant").alias("variant_short")))


def variant_pareto(counts: DataFrame, k: int = 20) -> DataFrame:
    """WIN-6 / CHT-8: top-k variants with cumulative coverage of all cases."""
    tot = counts.agg(F.sum("n_cases").alias("_tot"))
    w = Window.orderBy(F.desc("n_cases"))  # over k rows; equal ones are equal in every column
    return (_largest(counts, k).crossJoin(F.broadcast(tot))
            .select(F.row_number().over(w).cast("long").alias("variant_rank"), "n_cases",
                    (F.sum("n_cases").over(w.rowsBetween(Window.unboundedPreceding, 0))
                     / F.col("_tot") * 100).alias("cumulative_pct"))
            .withColumn("above_80", (F.col("cumulative_pct") >= 80).cast("int")))


def bucket_ranks(counts: DataFrame, log: DataFrame, slice_hours: int = 24) -> DataFrame:
    """``counts`` with a ``variant_rank`` that is right up to the last bounded
    rank bucket and null beyond: what DSC-6 needs."""
    last = RANK_BUCKETS[-1][0]
    first = first_variants(counts, log, last, slice_hours).select(CASE, "variant_rank")
    return counts.join(F.broadcast(first), CASE, "left")  # at most ``last`` rows


def breach_by_rank_bucket(cases_with_rank: DataFrame) -> DataFrame:
    """DSC-6: SLA-breach rate (%) per variant-rank bucket, present buckets
    only, with the display order."""
    return (cases_with_rank
            .groupBy(rank_bucket("variant_rank").alias("rank_bucket"),
                     rank_bucket_order("variant_rank").alias("bucket_order"))
            .agg((F.avg("sla_breach") * 100).alias("breach_rate_pct"),
                 F.count(F.lit(1)).alias("n_cases")))
