"""Calendar buckets (the dense fill lives in ``operators.weekly``).

Week rule (G1): a week ends on Sunday and is labelled by that Sunday; a
Sunday with a time of day stays in its own week.  ``date_trunc('week')``
gives the Monday; six days later is the label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQS = ("D", "W", "M")


def week_end(c: Column | str) -> Column:
    d = F.to_date(F.col(c) if isinstance(c, str) else c)
    return F.date_add(F.to_date(F.date_trunc("week", d)), 6)


def period_label(c: Column | str, freq: str = "W") -> Column:
    """Label of the period a date falls in: day, week-ending Sunday or month end."""
    col = F.col(c) if isinstance(c, str) else c
    if freq == "D":
        return F.to_date(col)
    if freq == "W":
        return week_end(col)
    if freq == "M":
        return F.last_day(F.to_date(col))
    raise ValueError(f"unsupported time_freq {freq!r}; use one of {FREQS}")
