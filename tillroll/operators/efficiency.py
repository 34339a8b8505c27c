"""Efficiency, regression and year-over-year measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import group_quantiles
from ..functions.safe import money, safe_div
from ..functions.scalar import with_row


def store_region_efficiency(df: DataFrame, store: str = "store", region: str = "region",
                            sales: str = "weekly_sales", txns: str = "transactions") -> DataFrame:
    """Per (store, region) sales, transactions and value per transaction
    with the denominator floored at 1."""
    g = df.groupBy(store, region).agg(F.sum(sales).alias("sales"), F.sum(txns).alias("txns"))
    vpt = F.col("sales").cast("double") / F.greatest(F.col("txns").cast("double"), F.lit(1.0))
    return g.select(store, region, money("sales").alias("sales"),
                    F.col("txns").cast("double").alias("txns"), vpt.alias("value_per_txn"))


def store_efficiency(df: DataFrame, store: str = "store", sales: str = "weekly_sales",
                     txns: str = "transactions") -> DataFrame:
    """Per store sales, transactions and sales / transactions."""
    g = df.where(F.col(store).isNotNull()).groupBy(store).agg(F.sum(sales).alias("sales"), F.sum(txns).alias("txns"))
    return g.select(store, money("sales").alias("sales"), F.col("txns").cast("double").alias("transactions"),
                    safe_div("sales", "txns").alias("avg_transaction_value"))


def quadrants(entity_table: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Medians of x and y over the entities and each entity's quadrant
    (high/low x, high/low y against the medians)."""
    mx = group_quantiles(entity_table, [], x, [0.5], names=["median_x"], with_count=None)
    my = group_quantiles(entity_table, [], y, [0.5], names=["median_y"], with_count=None)
    j = with_row(with_row(entity_table, mx), my)
    hx = F.when(F.col(x) >= F.col("median_x"), "high").otherwise("low")
    hy = F.when(F.col(y) >= F.col("median_y"), "high").otherwise("low")
    return j.select(*keys, x, y, "median_x", "median_y",
                    F.concat(hx, F.lit(f"_{x}_"), hy, F.lit(f"_{y}")).alias("quadrant"))


def regression(entity_table: DataFrame, x: str, y: str) -> DataFrame:
    """OLS line of y on x and R^2; fewer than 2 points -> zeros;
    constant y -> R^2 = 0 (Spark's regr_r2 would give 1)."""
    pts = entity_table.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    a = pts.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(yd, xd).alias("b1"),
                F.regr_intercept(yd, xd).alias("b0"), F.regr_r2(yd, xd).alias("r2"),
                F.var_pop(yd).alias("vy"))
    enough = F.col("n") >= 2
    return a.select(
        F.when(enough, F.coalesce("b1", F.lit(0.0))).otherwise(F.lit(0.0)).alias("slope"),
        F.when(enough, F.coalesce("b0", F.lit(0.0))).otherwise(F.lit(0.0)).alias("intercept"),
        F.when(enough & (F.col("vy") != 0), F.coalesce("r2", F.lit(0.0))).otherwise(F.lit(0.0)).alias("r2"),
        F.col("n").cast("long").alias("points"))


def yoy_delta(df: DataFrame, date: str = "date", value: str = "weekly_sales") -> DataFrame:
    """Total of the latest year in the data and the change vs the year
    before (no prior year or a zero prior total -> 0)."""
    d = df.where(F.col(date).isNotNull() & F.col(value).isNotNull()).withColumn("_y", F.year(date))
    yr = d.agg(F.max("_y").alias("_cy"))
    j = with_row(d, yr)
    a = j.agg(F.first("_cy").alias("current_year"),
              F.sum(F.when(F.col("_y") == F.col("_cy"), F.col(value))).alias("_cur"),
              F.sum(F.when(F.col("_y") == F.col("_cy") - 1, F.col(value))).alias("_py"),
              F.count_if(F.col("_y") == F.col("_cy") - 1).alias("_npy"))
    delta = F.when((F.col("_npy") == 0) | (F.coalesce(F.col("_py"), F.lit(0)) == 0), F.lit(0.0)) \
             .otherwise((F.col("_cur").cast("double") - F.col("_py").cast("double")) / F.col("_py").cast("double"))
    return a.select(F.col("current_year").cast("long"), money(F.coalesce("_cur", F.lit(0))).alias("current_total"),
                    money(F.coalesce("_py", F.lit(0))).alias("prior_total"), delta.alias("delta"))


def efficiency_metrics(df: DataFrame, store: str = "store", sales: str = "weekly_sales",
                       txns: str = "transactions") -> DataFrame:
    """Total sales, mean row sales (reported as avg_transaction_value, as
    the contract names it), active stores, sales per store, capacity
    utilisation = transactions / (rows * 100) * 100."""
    # rows are summed by store first, so the number of stores is a plain count
    per = df.groupBy(F.col(store).alias("_store")).agg(F.sum(sales).alias("_tot"), F.count(sales).alias("_ns"), F.sum(txns).alias("_tx"),
                                                       F.count(F.lit(1)).alias("_rows"))
    a = per.agg(F.sum("_tot").alias("_tot"), F.coalesce(F.sum("_ns"), F.lit(0)).alias("_ns"), F.count("_store").alias("_st"),
                F.sum("_tx").alias("_tx"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("_rows"))
    return a.select(
        money("_tot").alias("total_sales"),
        F.try_divide(F.col("_tot").cast("double"), F.col("_ns").cast("double")).alias("avg_transaction_value"),
        F.col("_st").cast("long").alias("active_stores"),
        F.try_divide(F.col("_tot").cast("double"), F.col("_st").cast("double")).alias("sales_per_store"),
        F.try_divide(F.col("_tx").cast("double"), (F.col("_rows") * 100).cast("double")).alias("_u"),
    ).withColumn("capacity_utilization", F.coalesce(F.col("_u") * 100, F.lit(0.0))).drop("_u")
