"""Global values attached to rows as scalar subqueries.

A global aggregate (overall mean, median, grand total, last week) is one
row.  Instead of joining it to every row, it is packed into one struct and
attached with ``DataFrame.scalar()``: Spark runs the subquery once and inlines
the value into the projection, so there is no join and nothing per row.  An
empty aggregate gives NULLs, never drops rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` plus the columns of the one-row frame ``row`` (names must differ)."""
    packed = row.select(F.struct(*[F.col(c) for c in row.columns]).alias("_r")).scalar()
    return df.select("*", packed.alias("_row")).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_row.`{c}`").alias(c) for c in row.columns])


def one_row(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Side-by-side combination of one-row frames into one report row.

    The frames are stacked (``unionByName`` with missing columns as NULL) and
    folded by one global aggregate that keeps each column's value from the
    frame that has it.  All frames are computed side by side in one job; column
    names must be distinct across frames.
    """
    frames = (first, *rest)
    names = [c for f in frames for c in f.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"one_row: duplicate column names in {names}")
    tagged = [f.select("*", F.lit(i).alias("_src")) for i, f in enumerate(frames)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    owner = {c: i for i, f in enumerate(frames) for c in f.columns}
    return u.agg(*[F.max_by(F.col(c), F.when(F.col("_src") == owner[c], F.lit(1))).alias(c) for c in names])
