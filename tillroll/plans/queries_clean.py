"""Cleaning, validation, quality and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bitmaps as B
from ..functions import sketches as SK
from ..operators import clean as C
from ..operators import outliers as O
from ..operators import quality as Q
from ..sources.rules import fact_rules
from ..sources.tables import dirty_fact, fact_view
from .catalog import register, with_fact

TIES = ("l_orderkey", "l_linenumber")

# DuckDB twin of sources.tables.dirty_fact (same fixed defect rules).
DIRTY_CTE = r"""raw0 AS (
  SELECT strftime(date, '%Y-%m-%d') AS ds, store, department, region, weekly_sales, transactions,
         l_orderkey AS k, l_linenumber AS ln FROM fact),
raw1 AS (
  SELECT CASE WHEN k % 227 = 0 THEN '2001-13-01' ELSE ds END AS date,
         CASE WHEN k % 211 = 0 THEN NULL WHEN ln = 7 THEN ' ' || store || chr(9) ELSE store END AS store,
         CASE WHEN k % 199 = 0 THEN NULL WHEN ln = 6 THEN chr(9) || department ELSE department END AS department,
         CASE WHEN k % 193 = 0 THEN NULL ELSE region END AS region,
         CASE WHEN k % 97 = 0 THEN NULL WHEN k % 101 = 0 THEN 'abc'
              WHEN k % 103 = 0 THEN '-' || CAST(weekly_sales AS VARCHAR)
              WHEN k % 107 = 0 THEN CAST(CAST(weekly_sales * 100 AS DECIMAL(18,4)) AS VARCHAR)
              ELSE CAST(weekly_sales AS VARCHAR) END AS weekly_sales,
         CASE WHEN k % 89 = 0 THEN NULL WHEN k % 109 = 0 THEN '12.5' WHEN k % 113 = 0 THEN '20000'
              WHEN k % 131 = 0 THEN '0'
              ELSE CAST(transactions AS VARCHAR) END AS transactions,
         k AS l_orderkey, ln AS l_linenumber FROM raw0),
raw AS (SELECT * FROM raw1 UNION ALL SELECT * FROM raw1 WHERE l_orderkey % 53 = 0)"""

TYPED_CTE = r"""typed AS (
  SELECT CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS date, store, department, region,
         TRY_CAST(weekly_sales AS DECIMAL(38,6)) AS weekly_sales,
         CASE WHEN TRY_CAST(transactions AS DOUBLE) = floor(TRY_CAST(transactions AS DOUBLE))
              THEN CAST(TRY_CAST(transactions AS DOUBLE) AS BIGINT) END AS transactions,
         l_orderkey, l_linenumber FROM raw)"""

CLEAN_CTE = r"""dated AS (SELECT * FROM typed WHERE date IS NOT NULL),
trimmed AS (
  SELECT date, regexp_replace(regexp_replace(store, '^\s+', ''), '\s+$', '') AS store,
         regexp_replace(regexp_replace(department, '^\s+', ''), '\s+$', '') AS department,
         regexp_replace(regexp_replace(region, '^\s+', ''), '\s+$', '') AS region,
         weekly_sales, transactions, l_orderkey, l_linenumber FROM dated),
dedup AS (SELECT DISTINCT * FROM trimmed),
clipped AS (
  SELECT date, store, department, region,
         CASE WHEN weekly_sales < 0 THEN 0 WHEN weekly_sales > 1000000 THEN 1000000 ELSE weekly_sales END AS weekly_sales,
         CASE WHEN transactions < 0 THEN 0 WHEN transactions > 10000 THEN 10000 ELSE transactions END AS transactions,
         l_orderkey, l_linenumber FROM dedup),
p1 AS (SELECT * FROM clipped WHERE weekly_sales IS NOT NULL),
med AS (SELECT quantile_cont(CAST(transactions AS DOUBLE), 0.5) AS m FROM p1),
p2 AS (SELECT date, store, department, region, weekly_sales,
              coalesce(CAST(transactions AS DOUBLE), med.m, 0.0) AS transactions, l_orderkey, l_linenumber
       FROM p1, med),
clean AS (
  SELECT date, store, coalesce(department, 'Unknown') AS department, coalesce(region, 'Unknown') AS region,
         weekly_sales, transactions, l_orderkey, l_linenumber
  FROM p2 WHERE date IS NOT NULL AND store IS NOT NULL)"""


def _cleaned(spark, sf):
    return C.clean(dirty_fact(spark, sf), fact_rules())


@register("clean_fact", with_fact("""
SELECT date, store, department, region, CAST(weekly_sales AS DOUBLE) AS weekly_sales,
       transactions, l_orderkey, l_linenumber FROM clean""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE))
def q_clean_fact(spark, sf):
    return _cleaned(spark, sf).withColumn("weekly_sales", F.col("weekly_sales").cast("double"))


@register("validation_report", with_fact("""
SELECT CAST(a.initial_rows AS BIGINT) AS initial_rows, CAST(8 AS BIGINT) AS initial_cols,
       CAST(a.invalid_dates AS BIGINT) AS invalid_dates,
       CAST(a.initial_rows - a.invalid_dates - b.final_rows AS BIGINT) AS cleaning_removed,
       round((a.initial_rows - a.invalid_dates - b.final_rows) * 100.0 / nullif(a.initial_rows - a.invalid_dates, 0), 6) AS cleaning_removed_pct,
       CAST(a.initial_rows - b.final_rows AS BIGINT) AS rows_removed,
       CAST(b.final_rows AS BIGINT) AS final_rows, CAST(b.zero_sales AS BIGINT) AS zero_sales,
       CAST(a.neg AS BIGINT) AS negative_sales_raw, CAST(b.neg AS BIGINT) AS negative_sales, a.first_date, a.last_date,
       concat_ws('; ', CASE WHEN b.neg > 0 THEN b.neg || ' rows with negative sales' END) AS error_text,
       concat_ws('; ', CASE WHEN a.invalid_dates > 0 THEN a.invalid_dates || ' rows without a valid date' END,
                 CASE WHEN a.initial_rows - a.invalid_dates - b.final_rows > 0
                      THEN (a.initial_rows - a.invalid_dates - b.final_rows) || ' rows removed by cleaning' END,
                 CASE WHEN b.zero_sales > b.final_rows * 0.1 THEN b.zero_sales || ' rows with zero sales' END) AS warning_text
FROM (SELECT count(*) AS initial_rows, count(*) FILTER (WHERE date IS NULL) AS invalid_dates,
             count(*) FILTER (WHERE weekly_sales < 0) AS neg, min(date) AS first_date, max(date) AS last_date FROM typed) a,
     (SELECT count(*) AS final_rows, count(*) FILTER (WHERE weekly_sales = 0) AS zero_sales,
             count(*) FILTER (WHERE weekly_sales < 0) AS neg FROM clean) b""",
    DIRTY_CTE, TYPED_CTE, CLEAN_CTE))
def q_validation_report(spark, sf):
    return C.validation_report(dirty_fact(spark, sf), fact_rules())


@register("dq_completeness", with_fact("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(8 AS BIGINT) AS cols,
       CAST(count(*) FILTER (WHERE date IS NULL) + count(*) FILTER (WHERE store IS NULL)
          + count(*) FILTER (WHERE department IS NULL) + count(*) FILTER (WHERE region IS NULL)
          + count(*) FILTER (WHERE weekly_sales IS NULL) + count(*) FILTER (WHERE transactions IS NULL)
          + count(*) FILTER (WHERE l_orderkey IS NULL) + count(*) FILTER (WHERE l_linenumber IS NULL) AS BIGINT) AS missing_count,
       round(coalesce((count(*) * 8 - (count(*) FILTER (WHERE date IS NULL) + count(*) FILTER (WHERE store IS NULL)
          + count(*) FILTER (WHERE department IS NULL) + count(*) FILTER (WHERE region IS NULL)
          + count(*) FILTER (WHERE weekly_sales IS NULL) + count(*) FILTER (WHERE transactions IS NULL)
          + count(*) FILTER (WHERE l_orderkey IS NULL) + count(*) FILTER (WHERE l_linenumber IS NULL))) * 100.0
          / nullif(count(*) * 8, 0), 100.0), 6) AS completeness
FROM typed""", DIRTY_CTE, TYPED_CTE))
def q_dq_completeness(spark, sf):
    # Completeness of the typed (coerced, not yet cleaned) upload.
    return Q.completeness(C.coerce_types(dirty_fact(spark, sf), fact_rules()))


@register("dq_missing_by_column", with_fact("""
SELECT column_name AS "column", CAST(missing AS BIGINT) AS missing,
       round(missing * 100.0 / n, 2) AS missing_pct, null_policy
FROM (SELECT count(*) AS n,
             count(*) FILTER (WHERE date IS NULL) AS m_date, count(*) FILTER (WHERE store IS NULL) AS m_store,
             count(*) FILTER (WHERE department IS NULL) AS m_department, count(*) FILTER (WHERE region IS NULL) AS m_region,
             count(*) FILTER (WHERE weekly_sales IS NULL) AS m_sales, count(*) FILTER (WHERE transactions IS NULL) AS m_txn
      FROM raw) a,
     (VALUES ('date', 'drop_row'), ('store', 'drop_row'), ('department', 'fill_unknown'),
             ('region', 'fill_unknown'), ('weekly_sales', 'drop_row'), ('transactions', 'impute_median')) p(column_name, null_policy),
     LATERAL (SELECT CASE column_name WHEN 'date' THEN m_date WHEN 'store' THEN m_store
                       WHEN 'department' THEN m_department WHEN 'region' THEN m_region
                       WHEN 'weekly_sales' THEN m_sales ELSE m_txn END AS missing)
WHERE missing > 0""", DIRTY_CTE))
def q_dq_missing(spark, sf):
    return Q.missing_by_column(dirty_fact(spark, sf), fact_rules())


BIZ_SQL = """
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(8 AS BIGINT) AS total_columns,
       CAST(count(DISTINCT store) AS BIGINT) AS store_count, count(DISTINCT store) >= 2 AS stores_ok,
       CAST(count(DISTINCT CAST(date_trunc('week', date) AS DATE) + 6) AS BIGINT) AS weeks_of_data,
       count(DISTINCT CAST(date_trunc('week', date) AS DATE) + 6) >= 4 AS weeks_ok,
       CAST(count(*) FILTER (WHERE transactions = 0 AND weekly_sales > 0) AS BIGINT) AS zero_txn_with_sales,
       CAST(count(*) FILTER (WHERE CAST(weekly_sales AS DOUBLE) / nullif(CAST(transactions AS DOUBLE), 0) > 50000) AS BIGINT) AS high_avg_transaction,
       CAST(coalesce(sum(weekly_sales), 0) AS DOUBLE) AS total_revenue,
       round(CAST(sum(weekly_sales) AS DOUBLE) / count(weekly_sales), 6) AS avg_weekly_sales,
       min(date) AS date_range_start, max(date) AS date_range_end,
       CAST(datediff('day', min(date), max(date)) AS BIGINT) AS date_range_days
FROM clean"""


@register("dq_business_checks", with_fact(BIZ_SQL, DIRTY_CTE, TYPED_CTE, CLEAN_CTE))
def q_dq_business(spark, sf):
    return Q.business_checks(_cleaned(spark, sf), fact_rules())


@register("active_stores_by_period", with_fact("""
SELECT 'year' AS period, CAST(year(week) AS BIGINT) AS label, CAST(count(DISTINCT store) AS BIGINT) AS stores, CAST(sum(weekly_sales) AS DOUBLE) AS sales
FROM w GROUP BY 2
UNION ALL SELECT 'quarter', CAST(year(week) * 10 + quarter(week) AS BIGINT), CAST(count(DISTINCT store) AS BIGINT), CAST(sum(weekly_sales) AS DOUBLE) FROM w GROUP BY 2
UNION ALL SELECT 'week', CAST(year(week) * 10000 + month(week) * 100 + day(week) AS BIGINT), CAST(count(DISTINCT store) AS BIGINT), CAST(sum(weekly_sales) AS DOUBLE) FROM w GROUP BY 2
UNION ALL SELECT 'all', 0, CAST(count(DISTINCT store) AS BIGINT), CAST(sum(weekly_sales) AS DOUBLE) FROM w""",
    "w AS (SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS week, store, weekly_sales FROM fact WHERE date IS NOT NULL)"))
def q_active_stores(spark, sf):
    """Q5, Q6, A22 for any period: the week bitmaps of one pass, merged by week, quarter, year and altogether."""
    weeks = B.weekly_bitmaps(fact_view(spark, sf).where("date IS NOT NULL"), sums={"sales": F.col("weekly_sales")})
    w = F.col("week")
    levels = {"week": F.year(w) * 10000 + F.month(w) * 100 + F.dayofmonth(w), "quarter": F.year(w) * 10 + F.quarter(w), "year": F.year(w), "all": F.lit(0)}
    out = None
    for period, label in levels.items():
        stores = B.merged_count(weeks, [label], "stores").withColumnRenamed("_k0", "label")
        sales = weeks.groupBy(label.alias("label")).agg(F.sum("sales").cast("double").alias("sales"))
        part = stores.join(sales, "label").select(F.lit(period).alias("period"), F.col("label").cast("long"), "stores", "sales")
        out = part if out is None else out.union(part)
    return out


@register("sketch_bounds_store", with_fact("""
SELECT store, CAST(count(weekly_sales) AS BIGINT) AS n, true AS quartiles_within, true AS distinct_within
FROM fact WHERE store IS NOT NULL GROUP BY store"""))
def q_sketch_bounds(spark, sf):
    """Stored weekly sketches merged to stores, held against the exact ranks of their quartiles and the exact number of orders."""
    f = fact_view(spark, sf)
    approx = SK.merged(SK.weekly_sketches(f, "store", "weekly_sales", "l_orderkey"), ["store"])
    x = F.col("weekly_sales").cast("double")
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    side = approx.select(F.col("store").alias("_s"), *probs, "distinct")
    ranks = [c for q in probs for c in (F.avg(F.when(x < F.col(q), 1.0).otherwise(0.0)).alias(f"{q}_below"), F.avg(F.when(x <= F.col(q), 1.0).otherwise(0.0)).alias(f"{q}_upto"))]
    rows = f.where("store IS NOT NULL").join(side, F.col("store") == F.col("_s")).groupBy("store").agg(F.count("weekly_sales").alias("n"), F.first("distinct").alias("distinct"), *ranks)
    orders = f.where("store IS NOT NULL").groupBy("store", "l_orderkey").agg(F.lit(1).alias("one")).groupBy(F.col("store").alias("_o")).agg(F.count(F.lit(1)).alias("orders"))
    # three times the documented errors, so that chance does not decide
    close = F.lit(True)
    for q, p in probs.items():
        close = close & (F.col(f"{q}_below") - 3 * SK.RANK_ERROR <= p) & (F.col(f"{q}_upto") + 3 * SK.RANK_ERROR >= p)
    near = F.abs(F.col("distinct") - F.col("orders")) <= 3 * SK.DISTINCT_ERROR * F.col("orders")
    return rows.join(orders, F.col("store") == F.col("_o")).select("store", "n", close.alias("quartiles_within"), near.alias("distinct_within"))


# Per-store IQR fences over a frame named src (k = 1.5, minimum 4 values).
def _iqr_ctes(src: str, k: float = 1.5, min_n: int = 4, key: str = "store") -> list[str]:
    g = f"{key}, " if key else ""
    grp = f"GROUP BY {key}" if key else ""
    keyfilter = f"AND {key} IS NOT NULL" if key else ""
    join = f"LEFT JOIN fen USING ({key})" if key else ", fen"
    return [
        f"""fen AS (
  SELECT {g}count(weekly_sales) AS n, quantile_cont(CAST(weekly_sales AS DOUBLE), 0.25) AS q1,
         quantile_cont(CAST(weekly_sales AS DOUBLE), 0.75) AS q3
  FROM {src} WHERE weekly_sales IS NOT NULL {keyfilter} {grp})""",
        f"""flagged AS (
  SELECT s.*, fen.q1 - {k} * (fen.q3 - fen.q1) AS lower_fence, fen.q3 + {k} * (fen.q3 - fen.q1) AS upper_fence,
         coalesce(fen.n >= {min_n} AND (CAST(s.weekly_sales AS DOUBLE) < fen.q1 - {k} * (fen.q3 - fen.q1)
                  OR CAST(s.weekly_sales AS DOUBLE) > fen.q3 + {k} * (fen.q3 - fen.q1)), false) AS is_outlier
  FROM {src} s {join})"""]


@register("quality_report", with_fact("""
SELECT v.*, c.missing_count, c.completeness, o.outlier_count, b.*,
       CAST(issues AS BIGINT) AS issues, CAST(warnings AS BIGINT) AS warnings,
       CASE WHEN c.completeness >= 95 AND issues = 0 AND warnings <= 2 THEN 'excellent'
            WHEN c.completeness >= 85 AND issues = 0 THEN 'good' ELSE 'needs_attention' END AS status,
       issues = 0 AS validation_passed
FROM (SELECT CAST(a.initial_rows AS BIGINT) AS initial_rows, CAST(8 AS BIGINT) AS initial_cols,
             CAST(a.invalid_dates AS BIGINT) AS invalid_dates,
             CAST(a.initial_rows - a.invalid_dates - z.final_rows AS BIGINT) AS cleaning_removed,
             round((a.initial_rows - a.invalid_dates - z.final_rows) * 100.0 / nullif(a.initial_rows - a.invalid_dates, 0), 6) AS cleaning_removed_pct,
             CAST(a.initial_rows - z.final_rows AS BIGINT) AS rows_removed,
             CAST(z.final_rows AS BIGINT) AS final_rows, CAST(z.zero_sales AS BIGINT) AS zero_sales,
             CAST(a.neg AS BIGINT) AS negative_sales_raw, CAST(z.neg AS BIGINT) AS negative_sales
      FROM (SELECT count(*) AS initial_rows, count(*) FILTER (WHERE date IS NULL) AS invalid_dates,
                   count(*) FILTER (WHERE weekly_sales < 0) AS neg FROM typed) a,
           (SELECT count(*) AS final_rows, count(*) FILTER (WHERE weekly_sales = 0) AS zero_sales,
                   count(*) FILTER (WHERE weekly_sales < 0) AS neg FROM clean) z) v,
     (SELECT CAST(count(*) FILTER (WHERE department IS NULL) + count(*) FILTER (WHERE region IS NULL)
                  + count(*) FILTER (WHERE store IS NULL) + count(*) FILTER (WHERE date IS NULL)
                  + count(*) FILTER (WHERE weekly_sales IS NULL) + count(*) FILTER (WHERE transactions IS NULL)
                  + count(*) FILTER (WHERE l_orderkey IS NULL) + count(*) FILTER (WHERE l_linenumber IS NULL) AS BIGINT) AS missing_count,
             round(coalesce((count(*) * 8 - (count(*) FILTER (WHERE department IS NULL) + count(*) FILTER (WHERE region IS NULL)
                  + count(*) FILTER (WHERE store IS NULL) + count(*) FILTER (WHERE date IS NULL)
                  + count(*) FILTER (WHERE weekly_sales IS NULL) + count(*) FILTER (WHERE transactions IS NULL)
                  + count(*) FILTER (WHERE l_orderkey IS NULL) + count(*) FILTER (WHERE l_linenumber IS NULL))) * 100.0
                  / nullif(count(*) * 8, 0), 100.0), 6) AS completeness FROM clean) c,
     (SELECT CAST(count(*) FILTER (WHERE is_outlier) AS BIGINT) AS outlier_count FROM flagged) o,
     (""" + BIZ_SQL + """) b,
     LATERAL (SELECT (CASE WHEN v.negative_sales > 0 THEN 1 ELSE 0 END)
                   + (CASE WHEN NOT b.stores_ok THEN 1 ELSE 0 END) + (CASE WHEN NOT b.weeks_ok THEN 1 ELSE 0 END) AS issues,
                     (CASE WHEN v.invalid_dates > 0 THEN 1 ELSE 0 END) + (CASE WHEN v.cleaning_removed > 0 THEN 1 ELSE 0 END)
                   + (CASE WHEN v.zero_sales > v.final_rows * 0.1 THEN 1 ELSE 0 END)
                   + (CASE WHEN o.outlier_count > 5 THEN 1 ELSE 0 END)
                   + (CASE WHEN b.zero_txn_with_sales > 0 THEN 1 ELSE 0 END)
                   + (CASE WHEN b.high_avg_transaction > 0 THEN 1 ELSE 0 END) AS warnings)""",
    DIRTY_CTE, TYPED_CTE, CLEAN_CTE, *_iqr_ctes("clean")))
def q_quality_report(spark, sf):
    return Q.quality_report(dirty_fact(spark, sf), fact_rules())


@register("date_bounds", with_fact("""
SELECT CAST(count(*) AS BIGINT) AS rows, min(date) AS first_date, max(date) AS last_date
FROM fact WHERE date >= DATE '1996-01-01' AND date <= DATE '2000-12-31'"""))
def q_date_bounds(spark, sf):
    r = fact_rules(min_date="1996-01-01", max_date="2000-12-31")
    f = C.apply_date_bounds(fact_view(spark, sf), r)
    return f.agg(F.count(F.lit(1)).cast("long").alias("rows"), F.min("date").alias("first_date"),
                 F.max("date").alias("last_date"))


# ---------------------------------------------------------------- outliers

@register("outlier_fences_store", with_fact("""
SELECT store, CAST(n AS BIGINT) AS n, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr
FROM fen""", _iqr_ctes("fact")[0]))
def q_outlier_fences(spark, sf):
    f = O.iqr_fences(fact_view(spark, sf), "weekly_sales", "store", 1.5)
    # Fences carry a 7th decimal (1.5 x quartiles of 4-place money): report the exact parts.
    return f.select("store", F.col("n").cast("long").alias("n"), F.round("q1", 6).alias("q1"),
                    F.round("q3", 6).alias("q3"), F.round(F.col("q3") - F.col("q1"), 6).alias("iqr"))


def _cleaned(spark, sf):
    """The cleaned upload, where single amounts were blown up: outliers exist."""
    return C.clean(dirty_fact(spark, sf), fact_rules())


@register("outlier_iqr_store", with_fact("""
SELECT date, store, CAST(weekly_sales AS DOUBLE) AS weekly_sales, l_orderkey, l_linenumber
FROM flagged WHERE is_outlier""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE, *_iqr_ctes("clean")))
def q_outlier_iqr_store(spark, sf):
    f = O.flag_outliers_iqr(_cleaned(spark, sf), "weekly_sales", "store", 1.5)
    return f.where("is_outlier").select("date", "store", F.col("weekly_sales").cast("double"), *TIES)


@register("outlier_iqr_global", with_fact("""
SELECT date, store, CAST(weekly_sales AS DOUBLE) AS weekly_sales, l_orderkey, l_linenumber
FROM flagged WHERE is_outlier""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE, *_iqr_ctes("clean", key="")))
def q_outlier_iqr_global(spark, sf):
    f = O.flag_outliers_iqr(_cleaned(spark, sf), "weekly_sales", None, 1.5)
    return f.where("is_outlier").select("date", "store", F.col("weekly_sales").cast("double"), *TIES)


@register("outlier_count", with_fact("""
SELECT CAST(count(*) FILTER (WHERE is_outlier) AS BIGINT) AS outliers FROM flagged""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE, *_iqr_ctes("clean")))
def q_outlier_count(spark, sf):
    return O.outlier_count(_cleaned(spark, sf), value="weekly_sales", group_by="store", k=1.5)


@register("outlier_sample", with_fact("""
SELECT date, store, CAST(weekly_sales AS DOUBLE) AS weekly_sales FROM flagged WHERE is_outlier
ORDER BY date, store, weekly_sales LIMIT 20""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE, *_iqr_ctes("clean")))
def q_outlier_sample(spark, sf):
    f = O.flag_outliers_iqr(_cleaned(spark, sf), "weekly_sales", "store", 1.5)
    return Q.outlier_sample(f, 20)


@register("outlier_table", with_fact("""
SELECT date, store, department, sales,
       CASE WHEN sign(sales - median(sales) OVER ()) > 0 THEN 'Spike'
            WHEN sign(sales - median(sales) OVER ()) < 0 THEN 'Drop' ELSE 'Anomaly' END AS z_flag,
       l_orderkey, l_linenumber
FROM (SELECT date, store, department, CAST(weekly_sales AS DOUBLE) AS sales, l_orderkey, l_linenumber
      FROM flagged WHERE is_outlier
      ORDER BY sales DESC, date, store, department, l_orderkey, l_linenumber LIMIT 50)""",
    DIRTY_CTE, TYPED_CTE, CLEAN_CTE, *_iqr_ctes("clean", min_n=1)))
def q_outlier_table(spark, sf):
    return O.outlier_table(_cleaned(spark, sf), 1.5, 50, ties=TIES)


@register("outlier_zscore_store", with_fact("""
SELECT f.store, CAST(count(*) FILTER (WHERE abs(CAST(weekly_sales AS DOUBLE) - mu) / nullif(sd, 0) > 3.0) AS BIGINT) AS outliers
FROM clean f JOIN st USING (store) GROUP BY f.store""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE,
    """st AS (SELECT store, avg(CAST(weekly_sales AS DOUBLE)) AS mu, stddev_samp(CAST(weekly_sales AS DOUBLE)) AS sd
       FROM clean WHERE store IS NOT NULL GROUP BY store)"""))
def q_outlier_zscore(spark, sf):
    f = O.flag_outliers_zscore(_cleaned(spark, sf), "weekly_sales", "store", 3.0)
    return f.where("store IS NOT NULL").groupBy("store").agg(F.count_if("is_outlier").cast("long").alias("outliers"))


@register("outlier_mad_store", with_fact("""
SELECT store, CAST(count(*) FILTER (WHERE dev > 3.0 * 1.4826 * mad) AS BIGINT) AS outliers
FROM dv JOIN (SELECT store, quantile_cont(dev, 0.5) AS mad FROM dv GROUP BY store) m USING (store)
GROUP BY store""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE,
    """md AS (SELECT store, quantile_cont(CAST(weekly_sales AS DOUBLE), 0.5) AS med FROM clean WHERE store IS NOT NULL GROUP BY store)""",
    """dv AS (SELECT f.store, abs(CAST(f.weekly_sales AS DOUBLE) - md.med) AS dev FROM clean f JOIN md USING (store))"""))
def q_outlier_mad(spark, sf):
    f = O.flag_outliers_mad(_cleaned(spark, sf), "weekly_sales", "store", 3.0)
    return f.where("store IS NOT NULL").groupBy("store").agg(F.count_if("is_outlier").cast("long").alias("outliers"))


@register("outlier_winsorize", with_fact("""
SELECT store, round(sum(CASE WHEN is_outlier AND CAST(weekly_sales AS DOUBLE) < lower_fence THEN lower_fence
                             WHEN is_outlier AND CAST(weekly_sales AS DOUBLE) > upper_fence THEN upper_fence
                             ELSE CAST(weekly_sales AS DOUBLE) END), 2) AS winsorized_sales,
       CAST(count(*) AS BIGINT) AS rows
FROM flagged GROUP BY store""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE, *_iqr_ctes("clean")))
def q_outlier_winsorize(spark, sf):
    w = O.treat_outliers(_cleaned(spark, sf), "weekly_sales", "store", 1.5, "winsorize")
    return w.groupBy("store").agg(F.round(F.sum("weekly_sales"), 2).alias("winsorized_sales"),
                                  F.count(F.lit(1)).cast("long").alias("rows"))


@register("outlier_remove", with_fact("""
SELECT CAST(count(*) AS BIGINT) AS rows_kept FROM flagged WHERE NOT is_outlier""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE, *_iqr_ctes("clean")))
def q_outlier_remove(spark, sf):
    r = O.treat_outliers(_cleaned(spark, sf), "weekly_sales", "store", 1.5, "remove")
    return r.agg(F.count(F.lit(1)).cast("long").alias("rows_kept"))


@register("outlier_report", with_fact("""
SELECT store, CAST(count(*) FILTER (WHERE is_outlier) AS BIGINT) AS outliers
FROM flagged WHERE store IS NOT NULL GROUP BY store HAVING count(*) FILTER (WHERE is_outlier) > 3""",
    DIRTY_CTE, TYPED_CTE, CLEAN_CTE, *_iqr_ctes("clean")))
def q_outlier_report(spark, sf):
    return O.outlier_report(_cleaned(spark, sf), "weekly_sales", "store", 1.5, 3)
