"""Distinct counts by mergeable bitmaps.

``count(DISTINCT a), count(DISTINCT b)`` copies every row once for each
distinct column.  Here entities get dense numbers from a small table, rows are
first summed by (entity, week) with map-side combine, and each week keeps a
bitmap of the numbers that it saw: 4 KB for each 32,768 entities, however many
rows there were.  Bitmaps of weeks merge by OR, so the distinct entities of
any set of weeks come from the weekly table without reading rows again, and
new weeks only add to it.  All counts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .calendar import week_end
from .ordering import running_totals

#: A Sunday before every date; week numbers count from it.
_FIRST_SUNDAY = "0001-01-07"


def week_number(label: Column | str) -> Column:
    """Whole weeks from the first Sunday of the calendar to the week-ending Sunday ``label``."""
    c = F.col(label) if isinstance(label, str) else label
    return F.floor(F.datediff(c, F.to_date(F.lit(_FIRST_SUNDAY))) / 7).cast("bigint")


def entity_numbers(df: DataFrame, entity: str) -> DataFrame:
    """(entity, number): numbers from 1 in the order of names; one row per entity that is not null."""
    names = df.where(F.col(entity).isNotNull()).select(entity).distinct()
    ranked = running_totals(names, [F.col(entity).asc()], None, pos_col="_rank", cum_col=None)
    return ranked.select(entity, F.col("_rank").alias("number"))


def weekly_bitmaps(df: DataFrame, date: str = "date", entity: str = "store", sums: dict[str, Column] | None = None,
                   least: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """(week, bucket, entities, <sums>, <least>, <most>): the entities of each week as bitmaps of 32,768 numbers, and sums,
    minima and maxima over its rows.

    Rows without a date have a null week, rows without an entity a null bucket
    and no bits.  Written once: what is merged from it reads a small table.
    """
    kinds = [(F.sum, sums or {}), (F.min, least or {}), (F.max, most or {})]
    measures = [f(c).alias(n) for f, named in kinds for n, c in named.items()]
    again = [f(n).alias(n) for f, named in kinds for n in named]
    grain = df.groupBy(week_end(date).alias("week"), F.col(entity).alias("_entity")).agg(*(measures or [F.count(F.lit(1)).alias("_rows")]))
    grain = cut_lineage(grain, "entity-weeks")
    numbers = entity_numbers(grain, "_entity")
    numbered = grain.join(numbers, "_entity", "left")
    out = numbered.groupBy("week", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("entities"), *again)
    return cut_lineage(out, "week-bitmaps")


def merged_count(bitmaps: DataFrame, by: Sequence[Column] = (), name: str = "entities") -> DataFrame:
    """(by, name): distinct entities of each group of weeks, from the weekly bitmaps."""
    keys = [c.alias(f"_k{i}") for i, c in enumerate(by)]
    named = [f"_k{i}" for i in range(len(by))]
    each = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("entities").alias("_all"))
    out = each.groupBy(*named).agg(F.coalesce(F.sum(F.bitmap_count("_all")), F.lit(0)).cast("long").alias(name))
    return out


def week_count(bitmaps: DataFrame, name: str = "weeks") -> DataFrame:
    """One row: distinct weeks of the table, itself a bitmap of week numbers."""
    n = week_number("week")
    each = (bitmaps.where("week IS NOT NULL").groupBy(F.bitmap_bucket_number(n).alias("_b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("_all")))
    return each.agg(F.coalesce(F.sum(F.bitmap_count("_all")), F.lit(0)).cast("long").alias(name))
