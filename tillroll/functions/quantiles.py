"""Exact per-group quantiles (linear interpolation), one path for all sizes.

``percentile`` keeps every distinct value of a group in one task, so a store
holding a third of all rows would sit in a single task.  Here no step is
keyed by the group alone:

1. Values are counted per (group, value), a partial aggregate that spreads a
   hot group over all tasks and collapses repeated values before the shuffle.
2. The counted values are dealt by range of (group, value), sorted, and
   written once, which fixes partition and place.
3. One row per (range partition, group) carries the number of values in it;
   windows over those rows (at most one per partition and group) give each
   group's size and where each partition begins in the group's order.
4. Each wanted order statistic is a rank inside one (partition, group): an
   equi-join on both finds it among that partition's running counts.

A global quantile is the same with no group columns: the join is then on the
partition alone, and no step needs a join without a key.

Steps 1-2 run when the helper is called (eager).  The result matches
``quantile_cont`` / pandas ``quantile`` (linear).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float], names: Sequence[str] | None = None,
                    with_count: str | None = "n") -> DataFrame:
    """One row per group (non-null keys) with one DOUBLE column per probability.

    Nulls in ``value`` are skipped, so groups without values have no row.
    ``keys=[]`` gives a single global row, of nulls if there are no values.
    """
    return quantiles_of(counted_values(df, keys, value), keys, probs, names, with_count)


def counted_values(df: DataFrame, keys: Sequence[str], value: str | Column, times: str | None = None) -> DataFrame:
    """Steps 1 and 2: (keys, _x, _c, _at), each group's distinct values with their counts, written in order.

    Whatever depends on a group's values alone can be taken from it instead of from the rows.
    ``times``: a column that tells how often a row counts.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = list(keys)
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = F.col(times) if times else F.lit(1)
    base = df.select(*[F.col(k) for k in keys], value.cast("double").alias("_x"), often.cast("bigint").alias("_one")).where(F.col("_x").isNotNull())
    for k in keys:
        base = base.where(F.col(k).isNotNull())
    counted = base.groupBy(*keys, "_x").agg(F.sum("_one").alias("_c"))
    order = [*keys, "_x"]
    return cut_lineage(counted.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
                       .withColumn("_at", F.monotonically_increasing_id()), "quantile-values")


def quantiles_of(placed: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str] | None = None,
                 with_count: str | None = "n") -> DataFrame:
    """Steps 3 and 4, from the table of ``counted_values``."""
    keys = list(keys)
    order = [*keys, "_x"]
    names = list(names) if names else [f"q{int(round(p * 100))}" for p in probs]
    placed = placed.withColumn("_pid", F.shiftright("_at", 33))

    group = Window.partitionBy(*keys)
    before = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (placed.groupBy("_pid", *keys).agg(F.sum("_c").alias("_rows"))
              .withColumns({"_off": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_n": F.sum("_rows").over(group)}))

    # the two order statistics around each probability, as ranks from 0
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    ranks = pieces.select("*", wanted.alias("_w")).withColumn("_h", (F.col("_n") - 1) * F.col("_w.p"))
    side = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.floor("_h").alias("r")), F.struct(F.lit(1).alias("s"), F.ceil("_h").alias("r"))))
    targets = (ranks.select("*", side.alias("_t"))
               .where((F.col("_t.r") >= F.col("_off")) & (F.col("_t.r") < F.col("_off") + F.col("_rows")))
               .select("_pid", *keys, F.col("_w.i").alias("_i"), F.col("_t.s").alias("_s"),
                       (F.col("_t.r") - F.col("_off")).alias("_r"), (F.col("_h") - F.floor("_h")).alias("_frac"), "_n"))

    inside = Window.partitionBy("_pid", *keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.select("_pid", *order, "_c", F.sum("_c").over(inside).alias("_cum"))
    hits = running.join(targets, ["_pid", *keys]).where(
        (F.col("_r") < F.col("_cum")) & (F.col("_r") >= F.col("_cum") - F.col("_c")))

    def at(i: int, s: int, c: str) -> Column:
        return F.max(F.when((F.col("_i") == i) & (F.col("_s") == s), F.col(c)))

    picked = hits.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[at(i, s, "_x").alias(f"_{i}_{s}") for i in range(len(probs)) for s in (0, 1)],
        *[at(i, 0, "_frac").alias(f"_{i}_f") for i in range(len(probs))])
    return picked.select(
        *keys, *([F.col("_n").alias(with_count)] if with_count else []),
        *[(F.col(f"_{i}_0") + (F.col(f"_{i}_1") - F.col(f"_{i}_0")) * F.col(f"_{i}_f")).alias(name)
          for i, name in enumerate(names)])
