"""Null-safe arithmetic under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b as DOUBLE; NULL when b is 0 or NULL (pandas gives inf/NaN there)."""
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double"))


def pct_change(cur: Column | str, prev: Column | str) -> Column:
    """(cur - prev) / prev as a fraction; NULL when prev is 0 or missing."""
    cur, prev = col_(cur).cast("double"), col_(prev).cast("double")
    return F.try_divide(cur - prev, prev)


def r6(c: Column | str) -> Column:
    """Ratios are reported as DOUBLE rounded to 6 places."""
    return F.round(col_(c).cast("double"), 6)


def money(c: Column | str) -> Column:
    """Money totals are summed exactly (DECIMAL) and reported as DOUBLE."""
    return col_(c).cast("double")


def clip(c: Column | str, lo=None, hi=None) -> Column:
    """Clip keeping NULLs NULL (``greatest``/``least`` would skip them)."""
    x = col_(c)
    out = x
    if lo is not None:
        out = F.when(x < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(x > F.lit(hi), F.lit(hi)).otherwise(out)
    return out
