"""Entity x week tables and the 4-week comparisons.

Entity x week sums are sparse (G3): only observed pairs.  Windows here are
partitioned by entity over the entity x week table, so a partition holds at
most one row per calendar week, however many rows the entity has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import week_end
from ..functions.ordering import first_by_order
from ..functions.safe import money, pct_change
from ..functions.text import signed_pct_text
from ..functions.scalar import one_row, with_row


def entity_week_sums(df: DataFrame, entity: str, date: str = "date", sales: str = "weekly_sales",
                     out: str = "sales") -> DataFrame:
    """Sum of sales per (entity, week ending Sunday); observed pairs only."""
    d = df.where(F.col(date).isNotNull() & F.col(entity).isNotNull() & F.col(sales).isNotNull())
    return d.groupBy(entity, week_end(date).alias("date")).agg(F.sum(sales).alias(out))


def store_4wk_aligned(df: DataFrame, store: str = "store", date: str = "date",
                      sales: str = "weekly_sales") -> DataFrame:
    """Last 4 weeks vs the 4 before, aligned to the last week of all stores.

    Stores with no week in the last 4 are absent; a missing previous block is
    0; change is NULL when the previous block is <= 0.  Sorted by last_4w desc.
    """
    w = entity_week_sums(df, store, date, sales)
    last = w.agg(F.max("date").alias("_last"))
    j = with_row(w, last)
    d = F.col("date")
    in_last = (d > F.date_sub("_last", 28)) & (d <= F.col("_last"))
    in_prev = (d > F.date_sub("_last", 56)) & (d <= F.date_sub("_last", 28))
    a = (j.groupBy(store)
         .agg(F.sum(F.when(in_last, F.col("sales"))).alias("_l4"),
              F.sum(F.when(in_prev, F.col("sales"))).alias("_p4"),
              F.count_if(in_last).alias("_nl"))
         .where(F.col("_nl") > 0))
    p4 = F.coalesce(F.col("_p4"), F.lit(0))
    chg = F.when(p4 > 0, pct_change("_l4", p4))
    return a.select(store, money("_l4").alias("last_4w"), money(p4).alias("prev_4w"),
                    chg.alias("change")).orderBy(F.col("last_4w").desc(), F.col(store))


def store_4wk_own_tail(df: DataFrame, store: str = "store", date: str = "date",
                       sales: str = "weekly_sales") -> DataFrame:
    """Per store, its own last 8 observed weeks: last 4 vs the (up to) 4
    before; fewer than 5 weeks -> previous 0; change NULL when previous is 0.
    Sorted by change desc, NULLs last; display values rounded half-to-even."""
    w = entity_week_sums(df, store, date, sales)
    rn = F.row_number().over(Window.partitionBy(store).orderBy(F.col("date").desc()))
    t = w.withColumn("_rn", rn).where(F.col("_rn") <= 8)
    a = t.groupBy(store).agg(F.count(F.lit(1)).alias("_n"),
                             F.sum(F.when(F.col("_rn") <= 4, F.col("sales"))).alias("_l4"),
                             F.sum(F.when(F.col("_rn") > 4, F.col("sales"))).alias("_p4"))
    l4 = F.coalesce(F.col("_l4"), F.lit(0)).cast("double")
    p4 = F.when(F.col("_n") >= 5, F.coalesce(F.col("_p4"), F.lit(0))).otherwise(F.lit(0)).cast("double")
    pct = F.when(p4 != 0, (l4 - p4) / p4)
    out = a.select(store, l4.alias("last_4w"), p4.alias("prev_4w"), pct.alias("pct_change"))
    return out.select(
        store, F.bround("last_4w", 0).cast("long").alias("last_4w_rounded"),
        F.bround("prev_4w", 0).cast("long").alias("prev_4w_rounded"), "pct_change",
        signed_pct_text("pct_change").alias("change_text")
    ).orderBy(F.col("pct_change").desc_nulls_last(), F.col(store))


def store_4wk_rolling(df: DataFrame, store: str = "store", date: str = "date",
                      sales: str = "weekly_sales") -> DataFrame:
    """Rolling 4-week sum and the 4 weeks before it (both complete),
    taken at each store's last such week."""
    w = entity_week_sums(df, store, date, sales)
    o = Window.partitionBy(store).orderBy("date")
    r = (w.withColumn("_l4", F.sum("sales").over(o.rowsBetween(-3, 0)))
          .withColumn("_nl", F.count(F.lit(1)).over(o.rowsBetween(-3, 0)))
          .withColumn("_p4", F.sum("sales").over(o.rowsBetween(-7, -4)))
          .withColumn("_np", F.count(F.lit(1)).over(o.rowsBetween(-7, -4)))
          .where((F.col("_nl") == 4) & (F.col("_np") == 4)))
    last = r.withColumn("_k", F.row_number().over(Window.partitionBy(store).orderBy(F.col("date").desc()))) \
            .where(F.col("_k") == 1)
    return last.select(store, "date", money("_l4").alias("last_4w"), money("_p4").alias("prev_4w"),
                       pct_change("_l4", "_p4").alias("delta"))


def region_last_week_growth(df: DataFrame, region: str = "region", date: str = "date",
                            sales: str = "weekly_sales") -> DataFrame:
    """W12 (+J2): each region's last observed week, its sales and % growth vs
    the region's previous observed week.  Sorted by sales desc."""
    w = entity_week_sums(df, region, date, sales)
    o = Window.partitionBy(region).orderBy("date")
    g = w.withColumn("_prev", F.lag("sales").over(o)) \
         .withColumn("_k", F.row_number().over(Window.partitionBy(region).orderBy(F.col("date").desc())))
    last = g.where(F.col("_k") == 1)
    growth = pct_change("sales", "_prev") * 100
    return last.select(region, "date", money("sales").alias("weekly_sales"),
                       growth.alias("growth")).orderBy(F.col("weekly_sales").desc(), F.col(region))


def store_pulse(aligned: DataFrame, store: str = "store") -> DataFrame:
    """growing/declining counts, best and worst store by W9 change (%)."""
    t = aligned.where(F.col("change").isNotNull())
    a = aligned.agg(F.count_if(F.col("change") > 0).cast("long").alias("stores_growing"),
                    F.count_if(F.col("change") < 0).cast("long").alias("stores_declining"))
    b = t.agg(*first_by_order(t, store, "change", True, "best_store"),
              *first_by_order(t, store, "change", False, "worst_store"))
    return one_row(a, b).select(
        "stores_growing", "stores_declining", "best_store",
        (F.col("best_store_value") * 100).alias("best_growth_pct"), "worst_store",
        (F.col("worst_store_value") * 100).alias("worst_decline_pct"))


def week_sums_report(df: DataFrame, entity: str, **kw) -> DataFrame:
    s = entity_week_sums(df, entity, **kw)
    return s.select(entity, "date", money("sales").alias("sales"))
