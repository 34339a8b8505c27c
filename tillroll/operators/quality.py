"""Data-quality measures (Q1-Q13).

All measures are aggregates over the cleaned (or raw) frame; distinct counts
come from weekly bitmaps (``functions.bitmaps``), counts of an upload's rows
are observed while its rows are written.  Nothing loops over columns or rows
on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bitmaps import merged_count, week_count, weekly_bitmaps
from . import clean as C
from .outliers import outlier_count
from ..functions.scalar import one_row


def completeness(df: DataFrame) -> DataFrame:
    """Q1: missing cells and completeness % over all columns."""
    n = len(df.columns)
    miss = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    a = df.agg(F.count(F.lit(1)).alias("rows"), miss.alias("missing_count"))
    cells = F.col("rows") * n
    return a.select(F.col("rows").cast("long"), F.lit(n).cast("long").alias("cols"),
                    F.col("missing_count").cast("long"),
                    F.round(F.coalesce(F.try_divide((cells - F.col("missing_count")) * 100.0, cells),
                                       F.lit(100.0)), 6).alias("completeness"))


def missing_by_column(raw: DataFrame, rules: dict) -> DataFrame:
    """Q2: per column missing count and % (2 places), only where > 0,
    next to the column's null policy.  One aggregate, then unpivot."""
    pol = ((rules.get("cleaning", {}) or {}).get("null_policy") or {})
    cols = raw.columns
    a = raw.agg(F.count(F.lit(1)).alias("_n"),
                *[F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(cols)])
    stacked = a.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing"),
                 F.lit(pol.get(c, "none")).alias("null_policy")) for i, c in enumerate(cols)])).alias("s"))
    return (stacked.select(F.col("s.column").alias("column"), F.col("s.missing").cast("long").alias("missing"),
                           F.round(F.try_divide(F.col("s.missing") * 100.0, F.col("_n")), 2).alias("missing_pct"),
                           F.col("s.null_policy").alias("null_policy"))
            .where(F.col("missing") > 0))


def business_sums(df: DataFrame, date: str, store: str, sales: str, txns: str, max_avg: float) -> list[DataFrame]:
    """One-row frames from the weekly bitmaps of ``df``: sums, distinct stores, distinct weeks.  The rows are read once,
    and no row is copied for a DISTINCT."""
    atv = F.try_divide(F.col(sales).cast("double"), F.col(txns).cast("double"))
    one = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
    counts = {"total_rows": F.lit(1), "zero_txn_with_sales": one((F.col(txns) == 0) & (F.col(sales) > 0)), "high_avg_transaction": one(atv > max_avg),
              "zero_sales": one(F.col(sales) == 0), "negative_sales": one(F.col(sales) < 0),
              "missing_count": sum((one(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))}
    weeks = weekly_bitmaps(df, date, store, counts | {"_rev": F.col(sales), "_ns": one(F.col(sales).isNotNull())},
                           {"date_range_start": F.col(date)}, {"date_range_end": F.col(date)})
    sums = weeks.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts], F.sum("_rev").alias("_rev"), F.sum("_ns").alias("_ns"),
                     F.min("date_range_start").alias("date_range_start"), F.max("date_range_end").alias("date_range_end"))
    return [sums, merged_count(weeks, name="store_count"), week_count(weeks, "weeks_of_data")]


def _checks(a: DataFrame, rules: dict, columns: int) -> DataFrame:
    v = ((rules.get("cleaning", {}) or {}).get("validation") or {})
    return a.withColumns({
        "total_columns": F.lit(columns).cast("long"),
        "stores_ok": F.col("store_count") >= int(v.get("min_stores", 2)), "weeks_ok": F.col("weeks_of_data") >= int(v.get("min_weeks", 4)),
        "total_revenue": F.coalesce(F.col("_rev"), F.lit(0)).cast("double"),
        "avg_weekly_sales": F.round(F.try_divide(F.col("_rev").cast("double"), F.col("_ns")), 6),
        "date_range_days": F.datediff("date_range_end", "date_range_start").cast("long")})


BUSINESS = ["total_rows", "total_columns", "store_count", "stores_ok", "weeks_of_data", "weeks_ok", "zero_txn_with_sales", "high_avg_transaction",
            "total_revenue", "avg_weekly_sales", "date_range_start", "date_range_end", "date_range_days"]


def business_checks(df: DataFrame, rules: dict, date: str = "date", store: str = "store",
                    sales: str = "weekly_sales", txns: str = "transactions") -> DataFrame:
    """Q5-Q9, Q12 on the cleaned frame: one row."""
    return _checks(one_row(*business_sums(df, date, store, sales, txns, _max_avg(rules))), rules, len(df.columns)).select(*BUSINESS)


def _max_avg(rules: dict) -> float:
    return float((((rules.get("cleaning", {}) or {}).get("validation") or {})).get("max_avg_transaction", 50000))


def quality_report(raw: DataFrame, rules: dict, date: str = "date", store: str = "store",
                   sales: str = "weekly_sales", txns: str = "transactions") -> DataFrame:
    """Q13: validation + completeness + outliers + business checks -> status.

    issues   = negative sales after cleaning, too few stores, too few weeks
    warnings = invalid dates, rows removed by cleaning, >10% zero sales,
               >5 outliers, sales with zero transactions, high average ticket
    status   = excellent (>=95%, no issue, <=2 warnings) | good (>=85%, no
               issue) | needs_attention;  validation_passed = no issue (Q10, Q11).

    The upload is read once: its counts are observed while the deduplicated
    rows are written (``clean.clean_counted``).  The cleaned rows are read
    once for all sums and distinct counts (weekly bitmaps) and once, one
    column, for the values that quartiles and outliers come from.  Without
    the required columns the report is that of no rows, and never passes.
    """
    incomplete = bool(C.missing_columns(raw, rules))
    if incomplete:
        raw = C.empty_input(raw, rules)
    cleaned, counts = C.clean_counted(raw, rules, date, sales)
    oc = (rules.get("outliers", {}) or {})
    outl = outlier_count(cleaned, value=sales, group_by=oc.get("group_by", store), k=float(oc.get("k", 1.5))).select(F.col("outliers").alias("outlier_count"))
    r = _checks(one_row(*business_sums(cleaned, date, store, sales, txns, _max_avg(rules)), outl), rules, len(cleaned.columns))
    cells = F.col("total_rows") * len(cleaned.columns)
    r = C.with_stage_counts(r.withColumn("final_rows", F.col("total_rows")), counts, len(raw.columns))
    r = r.withColumn("completeness", F.round(F.coalesce(F.try_divide((cells - F.col("missing_count")) * 100.0, cells), F.lit(100.0)), 6))
    issues = (F.when(F.col("negative_sales") > 0, 1).otherwise(0)
              + F.when(~F.col("stores_ok"), 1).otherwise(0)
              + F.when(~F.col("weeks_ok"), 1).otherwise(0))
    warnings = (F.when(F.col("invalid_dates") > 0, 1).otherwise(0)
                + F.when(F.col("cleaning_removed") > 0, 1).otherwise(0)
                + F.when(F.col("zero_sales") > F.col("final_rows") * 0.1, 1).otherwise(0)
                + F.when(F.col("outlier_count") > 5, 1).otherwise(0)
                + F.when(F.col("zero_txn_with_sales") > 0, 1).otherwise(0)
                + F.when(F.col("high_avg_transaction") > 0, 1).otherwise(0))
    r = r.withColumn("issues", issues.cast("long")).withColumn("warnings", warnings.cast("long"))
    status = (F.when((F.col("completeness") >= 95) & (F.col("issues") == 0) & (F.col("warnings") <= 2), "excellent")
              .when((F.col("completeness") >= 85) & (F.col("issues") == 0), "good")
              .otherwise("needs_attention"))
    passed = F.lit(False) if incomplete else F.col("issues") == 0
    r = r.withColumn("status", F.lit("needs_attention") if incomplete else status).withColumn("validation_passed", passed)
    return r.select(*C.STAGE_COUNTS, "missing_count", "completeness", "outlier_count", *BUSINESS, "issues", "warnings", "status", "validation_passed")


def outlier_sample(flagged: DataFrame, n: int = 20, date: str = "date", store: str = "store",
                   sales: str = "weekly_sales") -> DataFrame:
    """First n flagged rows (date, store, sales) in (date, store, sales) order.
    The limit is the feature (a display sample); the count is taken apart."""
    return (flagged.where("is_outlier").select(date, store, F.col(sales).cast("double").alias(sales))
            .orderBy(date, store, sales).limit(n))
