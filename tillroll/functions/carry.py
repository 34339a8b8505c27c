"""Previous rows and group totals in one ordered pass (boundary carry).

A ``lag`` over an entity sorts the whole entity in one task, and a total
joined back to rows moves every row again.  Here the rows are dealt once by
range of (entity, order), so an entity that holds a third of all rows, or a
single day of it, spans as many partitions as it needs.  Each partition lags
and adds up what it has; what crosses a partition's edge is carried by at most
two rows of each partition: its last row, and the partial totals of its first
and last entity.  Those rows are the only ones that are joined, and their
number is bounded by the number of partitions, so they are broadcast.

The rows are written once (partition numbers must not change between the two
reads); nothing else is as large as the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bits of a row's position that number it inside its partition.
_ROW_BITS = 40


def carried(df: DataFrame, entity: str, order: Sequence[str], prev: Mapping[str, str] | None = None,
            totals: Mapping[str, Column] | None = None, position: str | None = None,
            num_partitions: int | None = None) -> DataFrame:
    """``df`` with columns of the row before and of the whole entity.

    * ``prev``: new column -> column whose value in the entity's previous row
      (by ``order``) it holds; null in an entity's first row and in rows
      without an entity.
    * ``totals``: new column -> expression whose sum over the entity's rows it
      holds (null if all are null).
    * ``position``: name of a BIGINT column that grows along (entity, order).

    ``order`` should be total; rows equal in it are in no defined order.  Rows
    without an entity form a group of their own in ``totals``.
    """
    prev, totals = dict(prev or {}), dict(totals or {})
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(entity), *[F.col(c) for c in order]]
    dealt = df.select("*", *[e.alias(f"_part_{i}") for i, e in enumerate(totals.values())])
    dealt = dealt.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id())
    line, own = Window.partitionBy("_pid").orderBy(*keys), Window.partitionBy("_pid", entity)
    row = F.struct(F.col(entity).alias("e"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(prev.values())])
    local = dealt.select(
        "*", F.lag(row).over(line).alias("_before"), F.row_number().over(line).alias("_rn"), F.lead(F.lit(True)).over(line).alias("_more"),
        *[F.sum(f"_part_{i}").over(own).alias(f"_sum_{i}") for i in range(len(totals))])
    local = cut_lineage(local.drop(*[f"_part_{i}" for i in range(len(totals))]), "in-order")

    sums = [f"_sum_{i}" for i in range(len(totals))]
    ends = local.where(F.col("_more").isNull()).select("_pid", row.alias("_end"))
    # one row for each partition
    over = ends.select("_pid", F.lag("_end").over(Window.orderBy("_pid")).alias("_over"))
    out = local.join(F.broadcast(over), "_pid", "left")
    before = F.when(F.col("_rn") == 1, F.col("_over")).otherwise(F.col("_before"))
    same = F.col(entity).isNotNull() & (before["e"] == F.col(entity))
    if sums:
        edge = local.where((F.col("_rn") == 1) | F.col("_more").isNull()).select("_pid", F.col(entity).alias("_e"), *sums)
        # a partition's first and last row may be of one entity; its sums then count once
        edge = edge.dropDuplicates(["_pid", "_e"]).groupBy("_e").agg(*[F.sum(s).alias(f"_whole{s}") for s in sums], F.count(F.lit(1)).alias("_spans"))
        out = out.join(F.broadcast(edge.where("_spans > 1")), F.col(entity).eqNullSafe(F.col("_e")), "left")
    cols = [F.col(f"`{c}`") for c in df.columns]
    cols += [F.when(same, before[f"v{i}"]).alias(name) for i, name in enumerate(prev)]
    cols += [F.when(F.col("_spans").isNotNull(), F.col(f"_whole{s}")).otherwise(F.col(s)).alias(name) for s, name in zip(sums, totals, strict=True)]
    if position:
        cols.append((F.shiftleft(F.col("_pid").cast("bigint"), _ROW_BITS) + F.col("_rn")).alias(position))
    return out.select(*cols)
