"""Global orderings without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row to one task.  For
entity tables (stores, departments) that may hold millions of rows we rank
and accumulate in a distributed way:

* top/bottom-1 come from a partial aggregate: ``min(struct(sort key, name))``.
* running totals and positions use a range-partitioned prefix sum.  Each
  range partition computes local cumulative values.  The per-partition
  totals (one row per partition, so the count is bounded by the partition
  count) are turned into offsets and broadcast back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def first_by_order(df: DataFrame, name: str, value: str, descending: bool,
                   prefix: str) -> list[Column]:
    """Aggregate expressions for the entity first in (value asc|desc, name asc) order.

    Ties on value go to the smallest name (G16).  NULL values are skipped.
    """
    v = F.col(value)
    key = (-v) if descending else v
    s = F.min(F.when(v.isNotNull(), F.struct(key.alias("k"), F.col(name).alias("n"), v.alias("v"))))
    return [s.getField("n").alias(f"{prefix}"), s.getField("v").alias(f"{prefix}_value")]


def running_totals(df: DataFrame, order: Sequence[Column], value: str | None,
                   pos_col: str = "rank", cum_col: str | None = "cum_value",
                   num_partitions: int | None = None) -> DataFrame:
    """Add the 1-based position in ``order`` and the running sum of ``value``.

    ``order`` must be a total order (end it with a unique key).  The plan is
    range exchange -> per-partition window -> materialised (so the partition
    ids are fixed) -> offsets from per-partition totals (one row per
    partition, broadcast).  No step holds more than a range partition's rows.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    val = F.col(value).cast("decimal(38,6)") if value else F.lit(0)
    ranged = (df.withColumn("_val", val)
              .repartitionByRange(n, *order)
              .withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = (ranged.withColumn("_lrn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
             .withColumn("_lcum", F.sum("_val").over(w)))
    # Both branches below must see the same range bounds: materialise once
    # (entity-sized) instead of letting each branch sample its own bounds.
    local = cut_lineage(local, "ranked")
    per_part = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pc"), F.sum("_val").alias("_ps"))
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_pid",
        F.coalesce(F.sum("_pc").over(wo), F.lit(0)).alias("_oc"),
        F.coalesce(F.sum("_ps").over(wo), F.lit(0)).alias("_os"))
    out = local.join(F.broadcast(offsets), "_pid")
    out = out.withColumn(pos_col, (F.col("_oc") + F.col("_lrn")).cast("long"))
    if cum_col:
        out = out.withColumn(cum_col, F.col("_os") + F.col("_lcum"))
    return out.drop("_val", "_pid", "_lrn", "_lcum", "_oc", "_os")


def default_ties(df: DataFrame, exclude: Sequence[str], first: str | None = None) -> list[str]:
    """A deterministic row order when the caller names no tie columns (G14):
    the value first, then every other column by name.  Rows equal in all
    columns are interchangeable, so the result does not depend on input order."""
    rest = sorted(c for c in df.columns if c not in set(exclude) and c != first)
    return ([first] if first else []) + rest
