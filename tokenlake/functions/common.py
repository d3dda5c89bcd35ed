"""Small scalar helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Epoch microseconds of a TIMESTAMP / TIMESTAMP_NTZ column.

    Durations are carried as integer microseconds and divided once at the
    end, so sums are exact and independent of summation order.
    """
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def safe_div(num, den) -> Column:
    """NULL instead of a division-by-zero error (ANSI mode), F.20."""
    return F.try_divide(col(num), col(den))


def array_tail(arr, n) -> Column:
    """Python ``a[-n:]`` (F.9 / O7); plain slice(a,-n,n) is [] when n > size."""
    arr = col(arr)
    n = F.lit(n) if isinstance(n, int) else col(n)
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), F.greatest(n, F.lit(1)))


def token_estimate(text) -> Column:
    """``max(1, int(len(text) / 4))`` (F.8)."""
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4).cast("bigint"))


def truncate_label(text, limit: int = 28, keep: int = 25) -> Column:
    """Length >= 28 -> first 25 characters + '...' (O4)."""
    t = col(text)
    return F.when(F.length(t) < limit, t).otherwise(F.concat(F.substring(t, 1, keep), F.lit("...")))


def strip_ws(text) -> Column:
    """Python ``str.strip()`` for the usual whitespace (space, tab, CR, LF)."""
    return F.regexp_replace(col(text), r"^[\s]+|[\s]+$", "")
