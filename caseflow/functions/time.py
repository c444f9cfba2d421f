"""Time expressions on naive-UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.schema import SEQ, TS

MICROS_PER_HOUR = 3_600_000_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hours_between(start, end) -> Column:
    """(end - start) in fractional hours, exact to the microsecond."""
    return (F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double")
            / F.lit(MICROS_PER_HOUR))


def ts_slice(ts=TS, hours: int = 24) -> Column:
    """Monotone time-slice number used to split a long case into pieces.

    Only used as a partitioning salt, so any monotone function of ``ts`` is
    correct; whole hours since the epoch keep it zone-independent.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    h = F.timestamp_diff("HOUR", epoch, _c(ts))
    # non-nullable on purpose: ts is never NULL after cleaning, and a NULL-free
    # key stops the optimizer from adding a filter to one side of the slice
    # self-join only, which would keep the two sides from sharing one shuffle
    return F.coalesce(F.floor(h / F.lit(int(hours))).cast("long"), F.lit(0).cast("long"))


def format_ts(ts, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_c(ts), fmt)


def weekday_name(ts) -> Column:
    return F.date_format(_c(ts), "EEEE")


def month_short_name(ts) -> Column:
    return F.date_format(_c(ts), "MMM")
