"""Per-store, region and department metrics.

Every entity measure is a partial aggregate (map-side combine), so a store
holding a third of all rows costs one hash-table entry per map task.  Row-tail
trends (last 8 rows of an entity) use ``row_number <= 8``, which Spark plans
as a partial WindowGroupLimit *before* the shuffle: each map task forwards at
most 8 rows per entity.  Orderings over the entity tables (top/bottom,
cumulative Pareto) never use a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import default_ties, first_by_order, running_totals
from ..functions.safe import money, r6, safe_div
from ..functions.scalar import with_row


def row_tail_trend(df: DataFrame, entity: str, date: str = "date", sales: str = "weekly_sales",
                   ties: Sequence[str] = (), absent_as_null: bool = False,
                   out: str = "trend_4wk", position: str | None = None) -> DataFrame:
    """Sum of the entity's last 4 rows vs the 4 rows before, by (date, ties)
    or by a ``position`` column that grows along that order.

    Fewer than 8 rows or a prior sum <= 0 gives 0.0 (store, region) or NULL
    (department: ``absent_as_null``).
    """
    line = [position] if position else [date, *(list(ties) or default_ties(df, [entity, date], sales))]
    order = [F.col(c).desc() for c in line]
    w = Window.partitionBy(entity).orderBy(*order)
    tail = (df.where(F.col(entity).isNotNull())
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 8))
    s = F.col(sales)
    agg = tail.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_n8"),
        F.sum(F.when(F.col("_rn") <= 4, s)).alias("_recent"),
        F.sum(F.when(F.col("_rn") > 4, s)).alias("_prior"))
    ok = (F.col("_n8") >= 8) & (F.col("_prior") > 0)
    val = (F.col("_recent").cast("double") - F.col("_prior").cast("double")) / F.col("_prior").cast("double")
    trend = F.when(ok, val) if absent_as_null else F.when(ok, val).otherwise(F.lit(0.0))
    return agg.select(entity, trend.alias(out))


def store_metrics(df: DataFrame, store: str = "store", date: str = "date",
                  sales: str = "weekly_sales", txns: str = "transactions",
                  ties: Sequence[str] = (), position: str | None = None) -> DataFrame:
    """A2-A4 + W7: one row per store.

    ``df`` should carry the derived fields (avg_transaction_value,
    store_efficiency_pct, wow_pct); missing ones come out NULL.  With a
    ``position`` column (``add_derived_fields``) the last change of a store is
    a hash aggregate over whole numbers instead of one sorted by (date, ties).
    """
    cols = set(df.columns)
    aggs = [F.sum(sales).alias("_s"), F.sum(txns).alias("_t")]
    if "avg_transaction_value" in cols:
        aggs.append(F.avg("avg_transaction_value").alias("avg_transaction_value"))
    if "store_efficiency_pct" in cols:
        aggs.append(F.avg("store_efficiency_pct").alias("efficiency_pct"))
    if "wow_pct" in cols:
        base_cols = [c for c in df.columns if c not in ("avg_transaction_value", "store_efficiency_pct",
                                                        "wow_pct", "revenue_contribution_pct")]
        t_cols = list(ties) or default_ties(df.select(*base_cols), [store, date], sales)
        key = F.col(position) if position else F.struct(F.col(date), *[F.col(t) for t in t_cols])
        # A4: last non-null WoW in row order (NULL orderings are skipped by max_by).
        aggs.append(F.max_by("wow_pct", F.when(F.col("wow_pct").isNotNull(), key)).alias("week_over_week_pct"))
    base = df.where(F.col(store).isNotNull()).groupBy(store).agg(*aggs)
    trend = row_tail_trend(df, store, date, sales, ties, out="trend", position=position)
    out = base.join(trend, store, "left")
    sel = [F.col(store), money("_s").alias("total_sales"), F.col("_t").cast("double").alias("transactions"),
           r6("trend").alias("trend")]
    for c in ("avg_transaction_value", "efficiency_pct", "week_over_week_pct"):
        if c in out.columns:
            sel.append(r6(c).alias(c))
    return out.select(*sel)


def entity_totals(df: DataFrame, entity: str, sales: str = "weekly_sales",
                  txns: str | None = "transactions") -> DataFrame:
    aggs = [F.sum(sales).alias("sales")]
    if txns:
        aggs.append(F.sum(txns).alias("transactions"))
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(*aggs)


def top_bottom(totals: DataFrame, entity: str, value: str = "sales", prefix: str | None = None) -> DataFrame:
    """One row: top and bottom entity by value (ties: smallest name),
    plus the entity count.  Partial aggregates only."""
    p = prefix or entity
    return totals.agg(
        F.count(F.lit(1)).cast("long").alias(f"{p}_count"),
        *first_by_order(totals, entity, value, True, f"top_{p}"),
        *first_by_order(totals, entity, value, False, f"bottom_{p}"))


def store_summary(df: DataFrame, store: str = "store", sales: str = "weekly_sales") -> DataFrame:
    """A2 count + A5 top/bottom store with sales."""
    t = entity_totals(df, store, sales, None)
    r = top_bottom(t, store, "sales", "store")
    return r.select("store_count", "top_store", money("top_store_value").alias("top_store_sales"),
                    "bottom_store", money("bottom_store_value").alias("bottom_store_sales"))


def region_metrics(df: DataFrame, region: str = "region", date: str = "date",
                   sales: str = "weekly_sales", txns: str = "transactions",
                   ties: Sequence[str] = ()) -> DataFrame:
    """Per region sales, transactions, row-tail trend, sales per transaction (0 if none)."""
    t = entity_totals(df, region, sales, txns)
    tr = row_tail_trend(df, region, date, sales, ties)
    j = t.join(tr, region, "left")
    atv = F.when(F.col("transactions") > 0, safe_div("sales", "transactions")).otherwise(F.lit(0.0))
    return j.select(region, money("sales").alias("sales"), F.col("transactions").cast("double").alias("transactions"),
                    r6(F.coalesce("trend_4wk", F.lit(0.0))).alias("trend_4wk"), r6(atv).alias("avg_transaction_value"))


def department_metrics(df: DataFrame, department: str = "department", date: str = "date",
                       sales: str = "weekly_sales", ties: Sequence[str] = (), rounded: bool = True) -> DataFrame:
    """Per department sales, rank (sales desc, name asc), cumulative % of
    the total and row-tail trend (NULL when not computable).  The cumulative
    sum is a distributed prefix sum, not a single-partition window.  What
    compares the cumulative % with a limit takes it unrounded."""
    t = entity_totals(df, department, sales, None)
    ranked = running_totals(t, [F.col("sales").desc(), F.col(department).asc()], "sales",
                            pos_col="rank", cum_col="_cum")
    total = t.agg(F.sum("sales").alias("_total"))
    j = with_row(ranked, total)
    cum_pct = F.when(F.col("_total") != 0, F.col("_cum").cast("double") / F.col("_total").cast("double") * 100)
    tr = row_tail_trend(df, department, date, sales, ties, absent_as_null=True)
    return j.join(tr, department, "left").select(
        department, money("sales").alias("sales"), F.col("rank"), (r6(cum_pct) if rounded else cum_pct).alias("cumulative_pct"),
        r6("trend_4wk").alias("trend_4wk"))


def pareto_meta(dept: DataFrame) -> DataFrame:
    """A7 meta: departments with cumulative % <= 80 and the total count."""
    return dept.agg(F.count_if(F.col("cumulative_pct") <= 80).cast("long").alias("pareto_80_count"),
                    F.count(F.lit(1)).cast("long").alias("total_count"))


def top_n(totals: DataFrame, entity: str, value: str = "sales", n: int = 3, bottom: bool = False) -> DataFrame:
    """K1/K2: n largest (or smallest) entities; ties by name.  TakeOrderedAndProject."""
    v = F.col(value)
    return totals.orderBy(v.asc() if bottom else v.desc(), F.col(entity).asc()).limit(n)
