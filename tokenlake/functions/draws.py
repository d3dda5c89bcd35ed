"""Deterministic pseudo-random draws from column values.

Every "random" choice in the corpus builders is a hash of (salt, seed,
row key).  A draw is therefore a pure column expression: narrow, the same
for any partitioning, and identical when a lost task is recomputed --
unlike ``rand(seed)``, whose stream depends on partition layout.

The value is the first 32 bits of an md5 hex digest read as a bigint in
[0, 2**32).  DuckDB computes the same number with
``('0x' || substr(md5(s), 1, 8))::BIGINT``; ``duck_draw`` renders that
text for the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 2 ** 32


def _key(salt, cols) -> Column:
    parts = [F.lit(str(salt))]
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts.append(c.cast("string"))
    return F.concat_ws(":", *parts)


def draw(salt, *cols) -> Column:
    """Uniform bigint in [0, 2**32) from md5(salt:col1:col2...)."""
    return F.conv(F.substring(F.md5(_key(salt, cols)), 1, 8), 16, 10).cast("bigint")


def stem(salt, *cols) -> Column:
    """The key of a draw without its last column: ``draw_at(stem(salt, a), b)``
    is ``draw(salt, a, b)``, with the common part built once for many ``b``."""
    return _key(salt, cols)


def hex_at(stem: Column, last: Column) -> Column:
    """Eight hex digits that sort as ``draw_at`` does."""
    return F.substring(F.md5(F.concat(stem, F.lit(":"), last.cast("string"))), 1, 8)


def draw_at(stem: Column, last: Column) -> Column:
    """``draw`` with the last key column given apart (not null)."""
    return F.conv(hex_at(stem, last), 16, 10).cast("bigint")


def draw_mod(n, salt, *cols) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(draw(salt, *cols), F.lit(n)).cast("int")


def draw_unit(salt, *cols) -> Column:
    """Uniform double in [0, 1)."""
    return draw(salt, *cols) / F.lit(float(DRAW_RANGE))


def duck_draw(salt, *exprs: str) -> str:
    """DuckDB text of ``draw``; ``exprs`` are SQL expressions."""
    parts = ", ".join([f"'{salt}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT"


def duck_draw_mod(n, salt, *exprs: str) -> str:
    return f"CAST(({duck_draw(salt, *exprs)}) % {n} AS INTEGER)"
