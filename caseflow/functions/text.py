"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.model import VARIANT_SHORT_KEEP, VARIANT_SHORT_MAX


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze_whitespace(col) -> Column:
    """Runs of whitespace -> one space, then trim (NULL stays NULL)."""
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def sanitize_text(col) -> Column:
    """Export rule: runs of CR/LF/TAB -> one space, then trim (NULL kept)."""
    return F.trim(F.regexp_replace(_c(col), "[\\r\\n\\t]+", " "))


def short_text(col, max_len: int = VARIANT_SHORT_MAX,
               keep: int = VARIANT_SHORT_KEEP) -> Column:
    """Keep texts shorter than ``max_len``; cut longer ones to ``keep`` + '...'."""
    c = _c(col)
    return F.when(F.char_length(c) < max_len, c).otherwise(
        F.concat(F.substring(c, 1, keep), F.lit("...")))
