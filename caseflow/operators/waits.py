"""Waiting times, bottlenecks and directly-follows edges (BTN-1..5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.time import hours_between
from caseflow.model import REFERENCE_MODEL, ProcessModel
from caseflow.operators.ranking import quantiles, scalar_quantile
from caseflow.operators.sequence import with_previous
from caseflow.operators.util import materialised
from caseflow.schema import ACTIVITY, TS


def transitions(log: DataFrame, model: ProcessModel = REFERENCE_MODEL) -> DataFrame:
    """Every event with its predecessor in the case and the wait in hours."""
    tr = with_previous(log, model.slice_hours)
    return tr.withColumn("waiting_hours", hours_between("prev_ts", TS))


def valid_transitions(tr: DataFrame, model: ProcessModel = REFERENCE_MODEL) -> DataFrame:
    """Keep transitions with a predecessor and ``min <= wait < max`` hours."""
    return tr.filter(F.col("prev_activity").isNotNull()
                     & (F.col("waiting_hours") >= F.lit(float(model.wait_min_hours)))
                     & (F.col("waiting_hours") < F.lit(float(model.wait_max_hours))))


def bottleneck_stats(valid: DataFrame, model: ProcessModel = REFERENCE_MODEL) -> DataFrame:
    """Wait statistics keyed by the arriving activity, ranked by score.

    ``bottleneck_score`` = mean x count, which equals ``total_wait_hours``
    (kept as its own column for the dashboards).  Sums/means/counts are
    map-side combined; medians/p90 come from the distributed exact quantile
    operator (or a sketch when ``model.exact_quantiles`` is off).
    """
    out = quantiles(valid, "waiting_hours", {"median_wait_hours": 0.5, "p90_wait_hours": 0.9},
                    [ACTIVITY], exact=model.exact_quantiles,
                    extra={"mean_wait_hours": F.avg, "total_wait_hours": F.sum,
                           "n_occurrences": F.count})
    return out.select(
        ACTIVITY, "mean_wait_hours", "median_wait_hours", "total_wait_hours",
        "n_occurrences", "p90_wait_hours",
        (F.col("mean_wait_hours") / 24).alias("mean_wait_days"),
        (F.col("total_wait_hours") / 24).alias("total_wait_days"),
        (F.col("mean_wait_hours") * F.col("n_occurrences")).alias("bottleneck_score"))


def top_bottlenecks(stats: DataFrame, k: int = 10) -> DataFrame:
    """Top-k by score (ties: activity name), with 1-based ``bottleneck_rank``."""
    top = stats.orderBy(F.desc("bottleneck_score"), F.asc(ACTIVITY)).limit(k)
    # window over the k rows left after the limit (bounded by k)
    w = Window.orderBy(F.desc("bottleneck_score"), F.asc(ACTIVITY))
    return top.withColumn("bottleneck_rank", F.row_number().over(w).cast("long"))


def transition_waits(valid: DataFrame) -> DataFrame:
    """Directly-follows edges with their mean wait."""
    return (valid.groupBy(F.col("prev_activity").alias("from_activity"), ACTIVITY)
            .agg(F.avg("waiting_hours").alias("mean_wait_hours"),
                 F.count(F.lit(1)).alias("n_transitions")))


def wait_box_top(valid: DataFrame, stats: DataFrame | None = None, k: int = 5, cap_p: float = 0.95,
                 exact: bool = True) -> DataFrame:
    """Box statistics of the waits of the top-k bottlenecks, clipped at the
    global ``cap_p`` quantile of all valid waits.  One table of (activity,
    wait, number) is written and serves the ranking, the cap, the quartiles and
    the fences."""
    from caseflow.operators.charts import box_stats

    counts = materialised(valid.where("waiting_hours is not null").groupBy(ACTIVITY, "waiting_hours")
                          .agg(F.count(F.lit(1)).alias("_times")), "wait-counts")
    if stats is None:
        # the ranking needs mean times count only
        stats = counts.groupBy(ACTIVITY).agg(F.sum(F.col("waiting_hours") * F.col("_times")).alias("bottleneck_score"))
    cap = scalar_quantile(counts, "waiting_hours", cap_p, exact, weight="_times")
    # k rows
    top = F.broadcast(top_bottlenecks(stats, k).select(ACTIVITY, "bottleneck_rank"))
    clipped = (counts.join(top, ACTIVITY, "inner")
               .crossJoin(F.broadcast(cap))
               .select(ACTIVITY, F.least(F.col("waiting_hours"), F.col("q")).alias("wait_clipped"), "_times"))
    box = box_stats(clipped, "wait_clipped", [ACTIVITY], exact, weight="_times")
    return box.join(top, ACTIVITY, "inner")
