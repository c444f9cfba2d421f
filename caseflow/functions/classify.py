"""Classification expressions: outcome, duration bucket, rank bucket."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.model import (DURATION_BUCKET_LAST, DURATION_BUCKETS, RANK_BUCKET_LAST,
                            RANK_BUCKETS, ProcessModel)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def outcome_of(last_activity, model: ProcessModel) -> Column:
    """Map the last activity to an outcome class with a literal map (no join)."""
    items = sorted(model.outcome_map.items())
    if not items:
        return F.lit(model.outcome_default)
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(items)])
    return F.coalesce(F.try_element_at(m, _c(last_activity)), F.lit(model.outcome_default))


def duration_bucket(days) -> Column:
    """When-chain over the bucket bounds; NULL falls to the last label."""
    d = _c(days)
    expr = None
    for bound, label in DURATION_BUCKETS:
        expr = (F.when(d <= bound, label) if expr is None
                else expr.when(d <= bound, label))
    return expr.otherwise(DURATION_BUCKET_LAST)


def rank_bucket(rank) -> Column:
    r = _c(rank)
    expr = None
    for bound, label in RANK_BUCKETS:
        expr = F.when(r <= bound, label) if expr is None else expr.when(r <= bound, label)
    return expr.otherwise(RANK_BUCKET_LAST)


def rank_bucket_order(rank) -> Column:
    """Display position (1..5) of the rank bucket."""
    r = _c(rank)
    expr = None
    for i, (bound, _) in enumerate(RANK_BUCKETS, start=1):
        expr = F.when(r <= bound, i) if expr is None else expr.when(r <= bound, i)
    return expr.otherwise(len(RANK_BUCKETS) + 1)


def in_group(activity, prefix: str, members) -> Column:
    """Membership of the A/O groups of the order rule: set form or prefix form."""
    a = _c(activity)
    if members is not None:
        return a.isin(list(members))
    return a.startswith(prefix)
