"""Filter, derived-field and entity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import derive as D
from ..operators import entities as E
from ..operators import filters as FL
from ..operators import weekly as wk
from ..functions.safe import money
from ..sources.rules import fact_rules
from ..sources.tables import dirty_fact, fact_view
from .catalog import WEEKLY_CTE, register, with_fact
from .queries_clean import DIRTY_CTE, TYPED_CTE
from ..functions.scalar import with_row

TIES = ["l_orderkey", "l_linenumber"]
ORDER_SQL = "date, l_orderkey, l_linenumber"
ORDER_DESC_SQL = "date DESC, l_orderkey DESC, l_linenumber DESC"


def tail_cte(entity: str, name: str, null_default: bool = False) -> str:
    """Row-tail trend per entity (W7) in DuckDB SQL."""
    other = "" if null_default else " ELSE 0.0"
    return f"""{name}_tail AS (
  SELECT {entity}, weekly_sales,
         row_number() OVER (PARTITION BY {entity} ORDER BY {ORDER_DESC_SQL}) AS rn
  FROM fact WHERE {entity} IS NOT NULL),
{name} AS (
  SELECT {entity},
         CASE WHEN count(*) >= 8 AND sum(weekly_sales) FILTER (WHERE rn > 4) > 0 THEN
           (CAST(sum(weekly_sales) FILTER (WHERE rn <= 4) AS DOUBLE)
            - CAST(sum(weekly_sales) FILTER (WHERE rn > 4) AS DOUBLE))
           / CAST(sum(weekly_sales) FILTER (WHERE rn > 4) AS DOUBLE){other} END AS trend
  FROM {name}_tail WHERE rn <= 8 GROUP BY {entity})"""


DERIVED_CTE = f"""der AS (
  SELECT f.*, CAST(weekly_sales AS DOUBLE) / nullif(CAST(transactions AS DOUBLE), 0) AS atv,
         (CAST(weekly_sales AS DOUBLE) - CAST(lag(weekly_sales) OVER w AS DOUBLE))
           / nullif(CAST(lag(weekly_sales) OVER w AS DOUBLE), 0) * 100 AS wow_pct,
         sum(weekly_sales) OVER (PARTITION BY date) AS day_total
  FROM fact f WINDOW w AS (PARTITION BY store ORDER BY {ORDER_SQL})),
der2 AS (
  SELECT *, CASE WHEN avg(atv) OVER () > 0 THEN
              (avg(atv) OVER (PARTITION BY store) / avg(atv) OVER () - 1) * 100 END AS eff
  FROM der)"""


@register("filter_values", with_fact("""
SELECT 'department' AS "column", CAST(department AS VARCHAR) AS value FROM fact WHERE department IS NOT NULL GROUP BY 2
UNION ALL SELECT 'region', region FROM fact WHERE region IS NOT NULL GROUP BY 2
UNION ALL SELECT 'store', store FROM fact WHERE store IS NOT NULL GROUP BY 2"""))
def q_filter_values(spark, sf):
    return FL.filter_values(fact_view(spark, sf))


@register("filtered_weekly", with_fact("""
SELECT date, CAST(s AS DOUBLE) AS weekly_sales_sum, CAST(t AS DOUBLE) AS transactions_sum,
       round(wow, 6) AS wow_growth_pct, round(ma4, 6) AS ma_4wk
FROM growth""", WEEKLY_CTE.replace("FROM fact WHERE date IS NOT NULL",
                                   "FROM fact WHERE date IS NOT NULL AND region = 'ASIA'")))
def q_filtered_weekly(spark, sf):
    f = FL.apply_filters(fact_view(spark, sf), {"store": "All", "department": "", "region": "ASIA"})
    return wk.weekly_kpis(f)


@register("derived_fields", with_fact("""
SELECT date, store, l_orderkey, l_linenumber,
       atv AS avg_transaction_value, round(eff, 6) AS store_efficiency_pct, wow_pct,
       CAST(weekly_sales AS DOUBLE) / nullif(CAST(day_total AS DOUBLE), 0) * 100 AS revenue_contribution_pct
FROM der2""", DERIVED_CTE))
def q_derived_fields(spark, sf):
    d = D.add_derived_fields(fact_view(spark, sf), ties=TIES)
    # Single-division values are bit-identical across engines: not rounded.
    return d.select("date", "store", *TIES, "avg_transaction_value",
                    F.round("store_efficiency_pct", 6).alias("store_efficiency_pct"),
                    "wow_pct", "revenue_contribution_pct")


@register("store_metrics", with_fact(f"""
SELECT store, CAST(sum(weekly_sales) AS DOUBLE) AS total_sales, CAST(sum(transactions) AS DOUBLE) AS transactions,
       round(any_value(tr.trend), 6) AS trend, round(avg(atv), 6) AS avg_transaction_value,
       round(avg(eff), 6) AS efficiency_pct, round(any_value(lw.lw), 6) AS week_over_week_pct
FROM der2 JOIN tr USING (store) LEFT JOIN lw USING (store) GROUP BY store""",
    DERIVED_CTE, tail_cte("store", "tr"),
    f"""lw AS (SELECT store, wow_pct AS lw FROM (
          SELECT store, wow_pct, row_number() OVER (PARTITION BY store ORDER BY {ORDER_DESC_SQL}) AS rn
          FROM der WHERE wow_pct IS NOT NULL) WHERE rn = 1)"""))
def q_store_metrics(spark, sf):
    d = D.add_derived_fields(fact_view(spark, sf), ties=TIES, position="_at")
    return E.store_metrics(d, ties=TIES, position="_at")


@register("store_summary", with_fact("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM t) AS store_count,
       (SELECT store FROM t ORDER BY s DESC, store LIMIT 1) AS top_store,
       (SELECT CAST(s AS DOUBLE) FROM t ORDER BY s DESC, store LIMIT 1) AS top_store_sales,
       (SELECT store FROM t ORDER BY s ASC, store LIMIT 1) AS bottom_store,
       (SELECT CAST(s AS DOUBLE) FROM t ORDER BY s ASC, store LIMIT 1) AS bottom_store_sales""",
    "t AS (SELECT store, sum(weekly_sales) AS s FROM fact WHERE store IS NOT NULL GROUP BY store)"))
def q_store_summary(spark, sf):
    return E.store_summary(fact_view(spark, sf))


@register("region_metrics", with_fact("""
SELECT region, CAST(sum(weekly_sales) AS DOUBLE) AS sales, CAST(sum(transactions) AS DOUBLE) AS transactions,
       round(coalesce(any_value(rt.trend), 0.0), 6) AS trend_4wk,
       round(CASE WHEN sum(transactions) > 0 THEN CAST(sum(weekly_sales) AS DOUBLE) / CAST(sum(transactions) AS DOUBLE)
                  ELSE 0.0 END, 6) AS avg_transaction_value
FROM fact JOIN rt USING (region) GROUP BY region""", tail_cte("region", "rt")))
def q_region_metrics(spark, sf):
    return E.region_metrics(fact_view(spark, sf), ties=TIES)


DEPT_SQL = """
SELECT department, CAST(s AS DOUBLE) AS sales,
       CAST(row_number() OVER (ORDER BY s DESC, department) AS BIGINT) AS rank,
       round(CAST(sum(s) OVER (ORDER BY s DESC, department ROWS UNBOUNDED PRECEDING) AS DOUBLE)
             / CAST(nullif(sum(s) OVER (), 0) AS DOUBLE) * 100, 6) AS cumulative_pct,
       round(dt.trend, 6) AS trend_4wk
FROM (SELECT department, sum(weekly_sales) AS s FROM fact WHERE department IS NOT NULL GROUP BY department) d
LEFT JOIN dt USING (department)"""


#: The same with the cumulative share as it is, for what compares it.
DEPT_RAW_SQL = DEPT_SQL.replace("round(CAST(sum(s) OVER", "(CAST(sum(s) OVER").replace("* 100, 6) AS cumulative_pct", "* 100) AS cumulative_pct")


@register("department_metrics", with_fact(DEPT_SQL, tail_cte("department", "dt", null_default=True)))
def q_department_metrics(spark, sf):
    return E.department_metrics(fact_view(spark, sf), ties=TIES)


@register("department_pareto_meta", with_fact("""
SELECT CAST(count(*) FILTER (WHERE cumulative_pct <= 80) AS BIGINT) AS pareto_80_count,
       CAST(count(*) AS BIGINT) AS total_count FROM dm""",
    tail_cte("department", "dt", null_default=True), "dm AS (" + DEPT_RAW_SQL + ")"))
def q_department_pareto_meta(spark, sf):
    return E.pareto_meta(E.department_metrics(fact_view(spark, sf), ties=TIES, rounded=False))


@register("top_stores", with_fact("""
SELECT store, CAST(sum(weekly_sales) AS DOUBLE) AS sales FROM fact WHERE store IS NOT NULL
GROUP BY store ORDER BY sum(weekly_sales) DESC, store LIMIT 3"""))
def q_top_stores(spark, sf):
    t = E.entity_totals(fact_view(spark, sf), "store", txns=None)
    return E.top_n(t, "store", "sales", 3).select("store", money("sales").alias("sales"))


@register("bottom_departments", with_fact("""
SELECT department, CAST(sum(weekly_sales) AS DOUBLE) AS sales FROM fact WHERE department IS NOT NULL
GROUP BY department ORDER BY sum(weekly_sales) ASC, department LIMIT 3"""))
def q_bottom_departments(spark, sf):
    t = E.entity_totals(fact_view(spark, sf), "department", txns=None)
    return E.top_n(t, "department", "sales", 3, bottom=True).select("department", money("sales").alias("sales"))


@register("top_bottom_entities", with_fact("""
SELECT (SELECT region FROM r ORDER BY s DESC, region LIMIT 1) AS top_region,
       (SELECT CAST(s AS DOUBLE) FROM r ORDER BY s DESC, region LIMIT 1) AS top_region_sales,
       (SELECT region FROM r ORDER BY s ASC, region LIMIT 1) AS bottom_region,
       (SELECT CAST(s AS DOUBLE) FROM r ORDER BY s ASC, region LIMIT 1) AS bottom_region_sales,
       (SELECT department FROM d ORDER BY s DESC, department LIMIT 1) AS top_department,
       (SELECT CAST(s AS DOUBLE) FROM d ORDER BY s DESC, department LIMIT 1) AS top_department_sales,
       (SELECT department FROM d ORDER BY s ASC, department LIMIT 1) AS bottom_department,
       (SELECT CAST(s AS DOUBLE) FROM d ORDER BY s ASC, department LIMIT 1) AS bottom_department_sales""",
    "r AS (SELECT region, sum(weekly_sales) AS s FROM fact WHERE region IS NOT NULL GROUP BY region)",
    "d AS (SELECT department, sum(weekly_sales) AS s FROM fact WHERE department IS NOT NULL GROUP BY department)"))
def q_top_bottom_entities(spark, sf):
    f = fact_view(spark, sf)
    r = E.top_bottom(E.entity_totals(f, "region", txns=None), "region", "sales", "region")
    d = E.top_bottom(E.entity_totals(f, "department", txns=None), "department", "sales", "department")
    j = with_row(r, d)
    return j.select("top_region", money("top_region_value").alias("top_region_sales"),
                    "bottom_region", money("bottom_region_value").alias("bottom_region_sales"),
                    "top_department", money("top_department_value").alias("top_department_sales"),
                    "bottom_department", money("bottom_department_value").alias("bottom_department_sales"))


@register("above_average_stores", with_fact("""
SELECT store, CAST(s AS DOUBLE) AS sales FROM t
WHERE CAST(s AS DOUBLE) > (SELECT CAST(sum(s) AS DOUBLE) / count(*) FROM t)""",
    "t AS (SELECT store, sum(weekly_sales) AS s FROM fact WHERE store IS NOT NULL GROUP BY store)"))
def q_above_average_stores(spark, sf):
    t = E.entity_totals(fact_view(spark, sf), "store", txns=None).select("store", money("sales").alias("sales"))
    return FL.above_average(t, "sales", strict=True, above=True)


@register("at_or_below_average_stores", with_fact("""
SELECT store, CAST(s AS DOUBLE) AS sales FROM t
WHERE CAST(s AS DOUBLE) <= (SELECT CAST(sum(s) AS DOUBLE) / count(*) FROM t)""",
    "t AS (SELECT store, sum(weekly_sales) AS s FROM fact WHERE store IS NOT NULL GROUP BY store)"))
def q_at_or_below_average_stores(spark, sf):
    """the other side of the average."""
    t = E.entity_totals(fact_view(spark, sf), "store", txns=None).select("store", money("sales").alias("sales"))
    return FL.above_average(t, "sales", strict=True, above=False)


@register("complete_positive_rows", with_fact("""
SELECT date AS "Date", store AS "Store", CAST(weekly_sales AS DOUBLE) AS "Sales", l_orderkey AS "Order", l_linenumber AS "Line"
FROM typed WHERE date IS NOT NULL AND store IS NOT NULL AND region IS NOT NULL AND weekly_sales IS NOT NULL AND weekly_sales > 0""",
    DIRTY_CTE, TYPED_CTE))
def q_complete_positive_rows(spark, sf):
    """Complete rows of the typed upload with positive sales, under their display names."""
    typed = C.coerce_types(dirty_fact(spark, sf), fact_rules()).withColumn("sales", F.col("weekly_sales").cast("double"))
    rows = FL.positive_only(FL.drop_null_rows(typed, ["date", "store", "region", "weekly_sales"]), "sales")
    return FL.display_columns(rows, {"date": "Date", "store": "Store", "sales": "Sales", "l_orderkey": "Order", "l_linenumber": "Line"})
