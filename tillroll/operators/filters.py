"""Filters, predicates and projections.

Filters are plain column predicates placed before any derived window, so
Catalyst pushes them into the parquet scan (``PushedFilters``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import with_row

FILTER_KEYS = ("store", "department", "region")


def apply_filters(df: DataFrame, filters: dict | None, keys: Sequence[str] = FILTER_KEYS) -> DataFrame:
    """equality filters ANDed; "All", empty or a missing column = no filter."""
    if not filters:
        return df
    cond = None
    for k in keys:
        v = filters.get(k)
        if v in (None, "", "All") or k not in df.columns:
            continue
        c = F.col(k) == F.lit(v)
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


def filter_values(df: DataFrame, cols: Sequence[str] = FILTER_KEYS) -> DataFrame:
    """sorted distinct non-null values per filter column as (column, value).

    One scan: combinations of the columns' values collapse map-side first, and
    only those are spread into (column, value) pairs, which collapse again.
    """
    own = [c for c in cols if c in df.columns]
    if not own:
        return df.sparkSession.createDataFrame([], "column string, value string")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in own])).alias("p")
    return df.select(*own).distinct().select(pairs).select("p.*").where("value IS NOT NULL").distinct().orderBy("column", "value")


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """rows with a NULL in any of ``cols`` removed."""
    return df.na.drop(subset=list(cols))


def in_period(date_col: str, last: F.Column, start_weeks_back: int, end_weeks_back: int) -> F.Column:
    """(last - start*7 days, last - end*7 days], e.g. (4, 0) = last 4 weeks."""
    d = F.col(date_col)
    return (d > F.date_sub(last, 7 * start_weeks_back)) & (d <= F.date_sub(last, 7 * end_weeks_back))


def above_average(entity_table: DataFrame, value: str, strict: bool = True,
                  above: bool = True) -> DataFrame:
    """entities above (or at-or-below) the mean over entities; the mean
    is a one-row aggregate attached as a scalar subquery."""
    avg = entity_table.agg(F.avg(F.col(value).cast("double")).alias("_avg"))
    j = with_row(entity_table, avg)
    v = F.col(value).cast("double")
    if above:
        cond = v > F.col("_avg") if strict else v >= F.col("_avg")
    else:
        cond = v <= F.col("_avg") if strict else v < F.col("_avg")
    return j.where(cond).drop("_avg")


def positive_only(df: DataFrame, value: str) -> DataFrame:
    """F7."""
    return df.where(F.col(value) > 0)


def display_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """F8: projection with renaming, in mapping order."""
    return df.select(*[F.col(k).alias(v) for k, v in mapping.items()])
