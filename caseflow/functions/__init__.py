"""Column expressions (JVM-side, codegen-friendly; no Python UDFs)."""

from caseflow.functions.time import (hours_between, ts_slice, format_ts,
                                     weekday_name, month_short_name)
from caseflow.functions.text import squeeze_whitespace, sanitize_text, short_text
from caseflow.functions.classify import (outcome_of, duration_bucket, rank_bucket,
                                         rank_bucket_order, in_group)

__all__ = [
    "hours_between", "ts_slice", "format_ts", "weekday_name",
    "month_short_name", "squeeze_whitespace", "sanitize_text",
    "short_text", "outcome_of", "duration_bucket", "rank_bucket",
    "rank_bucket_order", "in_group",
]
