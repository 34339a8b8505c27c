"""Benchmarks, shares, Pareto and concentration.

All inputs are entity tables (one row per category).  The category mean and
total are one-row aggregates attached as scalar subqueries.  Rankings use the distributed
prefix sum (``running_totals``) or partial ``min(struct)`` aggregates, never
a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import first_by_order
from ..functions.safe import money
from ..session import cut_lineage
from ..functions.scalar import one_row, with_row


def category_sums(df: DataFrame, cat: str, value: str = "weekly_sales") -> DataFrame:
    return (df.where(F.col(value).isNotNull() & F.col(cat).isNotNull())
            .groupBy(cat).agg(F.sum(value).alias("value")))


def _mean_row(sums: DataFrame) -> DataFrame:
    # exact decimal total / count: one double, identical in every engine
    return sums.agg((F.sum("value").cast("double") / F.count(F.lit(1))).alias("avg"),
                    F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def benchmark(df: DataFrame, cat: str, value: str = "weekly_sales") -> DataFrame:
    """Per category sum, mean over categories, above (>= mean) flag,
    variance and % variance (0 when the mean is 0).  Sorted desc."""
    s = category_sums(df, cat, value)
    j = with_row(s, _mean_row(s).select("avg"))
    v = F.col("value").cast("double")
    var = v - F.col("avg")
    return j.select(cat, money("value").alias("value"), F.col("avg"),
                    (v >= F.col("avg")).alias("above_avg"), var.alias("variance"),
                    F.when(F.col("avg") == 0, F.lit(0.0)).otherwise(var / F.col("avg")).alias("variance_pct")
                    ).orderBy(F.col("value").desc(), F.col(cat))


def benchmark_context(df: DataFrame, cat: str, value: str = "weekly_sales") -> DataFrame:
    """Mean, top, bottom, count below (< mean), bottom gap %."""
    s = category_sums(df, cat, value)
    m = _mean_row(s)
    j = with_row(s, m.select("avg"))
    a = j.agg(F.first("avg").alias("avg_sales"),
              *first_by_order(j, cat, "value", True, "top"),
              *first_by_order(j, cat, "value", False, "bottom"),
              F.count_if(F.col("value").cast("double") < F.col("avg")).cast("long").alias("below_avg_count"))
    gap = F.when(F.col("avg_sales") != 0,
                 (F.col("avg_sales") - F.col("bottom_value").cast("double")) / F.col("avg_sales") * 100
                 ).otherwise(F.lit(0.0))
    return a.select("avg_sales", "top", "bottom", "below_avg_count", gap.alias("bottom_gap_pct"))


def benchmark_split(df: DataFrame, cat: str, value: str = "weekly_sales") -> DataFrame:
    """Count above (> mean) and at-or-below; top among above, bottom among below."""
    s = category_sums(df, cat, value)
    j = with_row(s, _mean_row(s).select("avg"))
    v = F.col("value").cast("double")
    above = j.withColumn("_above", v > F.col("avg"))
    a = above.agg(F.count(F.lit(1)).cast("long").alias("num"),
                  F.count_if("_above").cast("long").alias("above_avg"),
                  F.count_if(~F.col("_above")).cast("long").alias("below_avg"),
                  F.first("avg").alias("avg_sales"))
    hi = above.where("_above")
    lo = above.where("NOT _above")
    t = hi.agg(*first_by_order(hi, cat, "value", True, "top"))
    b = lo.agg(*first_by_order(lo, cat, "value", False, "bottom"))
    return one_row(a, t, b).select(
        "num", "above_avg", "below_avg", "top", F.coalesce(money("top_value"), F.lit(0.0)).alias("top_sales"),
        "bottom", F.coalesce(money("bottom_value"), F.lit(0.0)).alias("bottom_sales"), "avg_sales")


def share_top_n(df: DataFrame, cat: str, value: str = "weekly_sales", n: int = 5,
                other_label: str = "Others") -> DataFrame:
    """A21 + U1: top-n shares of the total, remainder as one "Others" row (only
    when positive); zero total -> share 0 and no "Others"."""
    s = cut_lineage(category_sums(df, cat, value), "category-sums")
    first = s.orderBy(F.col("value").desc(), F.col(cat).asc()).limit(n)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.col("value").desc(), F.col(cat).asc())).cast("long"))  # n rows
    top = with_row(ranked, _mean_row(s).select("total")).select(cat, "value", "rank", "total")
    # the rest is what the top rows leave of the total: no other row is ranked
    rest = (with_row(s.agg(F.sum("value").alias("total")), top.agg(F.sum("value").alias("_top")))
            .select(F.lit(other_label).alias(cat), (F.col("total") - F.col("_top")).alias("value"), F.lit(n + 1).cast("long").alias("rank"), "total")
            .where((F.col("value") > 0) & (F.col("total") != 0)))
    u = top.unionByName(rest)
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(
        F.col("value").cast("double") / F.col("total").cast("double"))
    return u.select(cat, money("value").alias("value"), "rank", share.alias("share"))


def pareto_cut(dept_metrics: DataFrame, cat: str = "department") -> DataFrame:
    """The first category (in rank order) whose cumulative % reaches 80;
    the last one when none does."""
    reach = dept_metrics.where(F.col("cumulative_pct") >= 80)
    first = reach.agg(F.min(F.struct("rank", cat, "cumulative_pct")).alias("f"))
    last = dept_metrics.agg(F.max(F.struct("rank", cat, "cumulative_pct")).alias("l"))
    pick = F.coalesce(F.col("f"), F.col("l"))
    return one_row(first, last).select(pick.getField(cat).alias(cat), pick.getField("rank").alias("rank"),
                                        pick.getField("cumulative_pct").alias("cumulative_pct"))


def region_concentration(region_metrics: DataFrame) -> DataFrame:
    """Top region share of the total (%) and balance = min / max (%)."""
    a = region_metrics.agg(F.max("sales").alias("mx"), F.min("sales").alias("mn"), F.sum("sales").alias("tot"))
    return a.select(F.try_divide(F.col("mx") * 100, F.col("tot")).alias("top_region_contribution_pct"),
                    F.try_divide(F.col("mn") * 100, F.col("mx")).alias("regional_balance"))


def department_concentration(dept_metrics: DataFrame) -> DataFrame:
    """Max share (all and positive-only), concentration level from the
    Pareto count (<=3 high, <=5 moderate, else balanced), % of departments in the 80%."""
    a = dept_metrics.agg(
        F.max("sales").alias("mx"), F.sum("sales").alias("tot"),
        F.max(F.when(F.col("sales") > 0, F.col("sales"))).alias("mxp"),
        F.sum(F.when(F.col("sales") > 0, F.col("sales"))).alias("totp"),
        F.count_if(F.col("cumulative_pct") <= 80).alias("pc"), F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("pc") <= 3, "high").when(F.col("pc") <= 5, "moderate").otherwise("balanced")
    return a.select(
        F.when(F.col("tot") > 0, F.col("mx") / F.col("tot") * 100).otherwise(F.lit(0.0)).alias("top_dept_share"),
        F.try_divide(F.col("mxp") * 100, F.col("totp")).alias("dept_concentration_pct"),
        F.col("pc").cast("long").alias("pareto_80_count"),
        F.when(F.col("tot") > 0, level).alias("concentration_level"),
        F.try_divide(F.col("pc") * 100.0, F.col("n")).alias("top_80_pct_of_departments"))


def top_departments(dept_metrics: DataFrame, n: int = 3, cat: str = "department") -> DataFrame:
    """Top n departments with sales, contribution % and trend % (missing trend -> 0)."""
    tot = dept_metrics.agg(F.sum("sales").alias("_tot"))
    j = with_row(dept_metrics.where(F.col("rank") <= n), tot)
    return j.select("rank", cat, "sales",
                    F.try_divide(F.col("sales") * 100, F.col("_tot")).alias("contribution_pct"),
                    (F.coalesce(F.col("trend_4wk"), F.lit(0.0)) * 100).alias("trend_pct"))
