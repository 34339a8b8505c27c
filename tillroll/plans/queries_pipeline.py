"""Bundle, source and stream queries (S1, S4-S6, 2.14)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..operators import clean as C
from ..functions.scalar import with_row
from ..operators import weekly as wk
from ..session import scratch_path
from ..sources.rules import fact_rules
from ..sources.tables import dirty_fact, fact_view, read_sales_csv
from ..streaming.weekly_stream import run_events_weekly
from .catalog import WEEKLY_CTE, register, with_fact
from .pipeline import compute_kpis
from .store_sink import store_weeks, store_years, write_store_weeks
from .queries_clean import CLEAN_CTE, DIRTY_CTE, TYPED_CTE, _iqr_ctes
from .queries_entities import DEPT_RAW_SQL, DEPT_SQL, DERIVED_CTE, ORDER_DESC_SQL, TIES, tail_cte

CLEAN_WEEKLY_CTE = WEEKLY_CTE.replace("FROM fact WHERE date IS NOT NULL", "FROM clean WHERE date IS NOT NULL")


@register("kpi_summary", with_fact("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM clean) AS record_count,
       (SELECT CAST(count(*) AS BIGINT) FROM clean) AS rows, CAST(13 AS BIGINT) AS cols,
       (SELECT round(CASE WHEN count(*) >= 8 AND avg(CASE WHEN k BETWEEN 5 AND 8 THEN sd END) > 0 THEN
          (avg(CASE WHEN k <= 4 THEN sd END) - avg(CASE WHEN k BETWEEN 5 AND 8 THEN sd END))
          / avg(CASE WHEN k BETWEEN 5 AND 8 THEN sd END) END, 6) FROM growth) AS trend_4wk,
       (SELECT round(max(CASE WHEN k = 1 THEN wow END), 6) FROM growth) AS wow_last,
       (SELECT CAST(count(*) AS BIGINT) FROM growth) AS weeks,
       (SELECT CAST(count(*) FILTER (WHERE is_outlier) AS BIGINT) FROM flagged) AS outliers""",
    DIRTY_CTE, TYPED_CTE, CLEAN_CTE, CLEAN_WEEKLY_CTE, *_iqr_ctes("clean")))
def q_kpi_summary(spark, sf):
    return compute_kpis(dirty_fact(spark, sf), fact_rules(), ties=TIES, outputs=["summary"])["summary"]


@register("kpi_bundle_weekly", with_fact("""
SELECT date, CAST(s AS DOUBLE) AS weekly_sales_sum, CAST(t AS DOUBLE) AS transactions_sum,
       round(wow, 6) AS wow_growth_pct, round(ma4, 6) AS ma_4wk
FROM growth""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE, CLEAN_WEEKLY_CTE))
def q_kpi_bundle_weekly(spark, sf):
    return compute_kpis(dirty_fact(spark, sf), fact_rules(), ties=TIES, outputs=["kpis_weekly"])["kpis_weekly"]


@register("csv_upload_weekly", with_fact("""
SELECT date, CAST(s AS DOUBLE) AS weekly_sales_sum, CAST(t AS DOUBLE) AS transactions_sum,
       round(wow, 6) AS wow_growth_pct, round(ma4, 6) AS ma_4wk
FROM growth""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE, CLEAN_WEEKLY_CTE))
def q_csv_upload_weekly(spark, sf):
    """The upload path: the raw table as a headed CSV in the shared folder
    (columns in another order than the rules name them, and one more), read
    back by header, cleaned, then weekly KPIs."""
    path = scratch_path(spark, f"upload-{uuid.uuid4().hex[:8]}")
    upload = dirty_fact(spark, sf).select("l_linenumber", "transactions", "store", F.lit('said "so"').alias("note"), "region",
                                          "weekly_sales", "l_orderkey", "date", "department")
    upload.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    raw = read_sales_csv(spark, path)
    raw = raw.withColumn("l_orderkey", F.col("l_orderkey").cast("bigint")) \
             .withColumn("l_linenumber", F.col("l_linenumber").cast("int"))
    return wk.weekly_kpis(C.clean(raw, fact_rules()))


@register("csv_inferred_types", with_fact("""
SELECT t."column", t.type, CAST(CASE t."column" WHEN 'shipped' THEN n - sevenths WHEN 'discount' THEN n - elevenths ELSE n END AS BIGINT) AS "values"
FROM (VALUES ('date', 'date'), ('store', 'string'), ('l_orderkey', 'bigint'), ('l_linenumber', 'bigint'), ('weekly_sales', 'decimal(38,6)'),
             ('shipped', 'timestamp_ntz'), ('discount', 'double'), ('returned', 'boolean'), ('code', 'string')) t("column", type),
     (SELECT count(*) AS n, count(*) FILTER (WHERE l_orderkey % 7 = 0) AS sevenths, count(*) FILTER (WHERE l_orderkey % 11 = 0) AS elevenths FROM fact)"""))
def q_csv_inferred_types(spark, sf):
    """Types of an upload's columns, the ones no rule names included."""
    _, typed = _typed_upload(spark, sf)
    kinds = {c: t for c, t in typed.dtypes}
    counts = typed.agg(*[F.count(F.col(c)).alias(c) for c in typed.columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c).alias("values")) for c in typed.columns]))
    return counts.select(each.alias("x")).select("x.*")


def _typed_upload(spark, sf):
    """The fact with columns that no rule names, as a CSV file and read back with inferred types."""
    path = scratch_path(spark, f"upload-{uuid.uuid4().hex[:8]}")
    k = F.col("l_orderkey")
    upload = fact_view(spark, sf).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "store", "l_orderkey", "l_linenumber", "weekly_sales",
        F.when(k % 7 != 0, F.concat(F.date_format(F.date_add("date", 2), "yyyy-MM-dd"), F.lit(" 08:30:00"))).alias("shipped"),
        F.when(k % 11 != 0, F.concat((k % 100).cast("string"), F.lit("e-2"))).alias("discount"),
        F.when(k % 2 == 0, "True").otherwise("false").alias("returned"),
        F.concat((k % 10).cast("string"), F.when(k % 3 == 0, "x").otherwise("")).alias("code"))
    upload.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)
    return path, read_sales_csv(spark, path, infer=True)


@register("csv_inferred_monthly", with_fact("""
SELECT CAST(date_trunc('month', date + 2) AS DATE) AS month, l_orderkey % 2 = 0 AS returned, CAST(count(*) AS BIGINT) AS rows,
       round(sum(CASE WHEN l_orderkey % 11 <> 0 THEN (l_orderkey % 100) / 100.0 END), 4) AS discount, CAST(sum(weekly_sales) AS DOUBLE) AS sales
FROM fact WHERE l_orderkey % 7 <> 0 GROUP BY 1, 2"""))
def q_csv_inferred_monthly(spark, sf):
    """Columns that no rule names are of use as they come: dates truncate, numbers add up, flags group."""
    _, typed = _typed_upload(spark, sf)
    return typed.where("shipped IS NOT NULL").groupBy(F.to_date(F.date_trunc("month", "shipped")).alias("month"), "returned").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("discount"), 4).alias("discount"), F.sum("weekly_sales").cast("double").alias("sales"))


@register("stream_weekly_events", """
SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS date, event_type,
       round(sum(value), 6) AS weekly_sales_sum, CAST(count(*) AS BIGINT) AS events
FROM events GROUP BY 1, 2""")
def q_stream_weekly(spark, sf):
    out = run_events_weekly(spark, sf, ("event_type",))
    return out.select("date", "event_type", F.round("weekly_sales_sum", 6).alias("weekly_sales_sum"),
                      F.col("events").cast("long").alias("events"))


@register("sink_store_years", with_fact("""
SELECT y.store, y.year, CAST(y.s AS DOUBLE) AS sales, y.weeks, CAST(p.s AS DOUBLE) AS previous_sales,
       (CAST(y.s AS DOUBLE) - CAST(p.s AS DOUBLE)) / nullif(CAST(p.s AS DOUBLE), 0) AS change
FROM y LEFT JOIN y p ON p.store = y.store AND p.year = y.year - 1""",
    "w AS (SELECT store, CAST(date_trunc('week', date) AS DATE) + 6 AS week, weekly_sales FROM fact WHERE date IS NOT NULL AND store IS NOT NULL)",
    "y AS (SELECT store, CAST(year(week) AS INTEGER) AS year, sum(weekly_sales) AS s, CAST(count(DISTINCT week) AS BIGINT) AS weeks FROM w GROUP BY 1, 2)"))
def q_sink_store_years(spark, sf):
    """Weekly store sums into the bucketed table in two uploads, the second of which replaces the years that it holds
    (first written with doubled sales), then year against year from the buckets."""
    name = f"store_weeks_{uuid.uuid4().hex[:8]}"
    weeks = store_weeks(fact_view(spark, sf))
    path = scratch_path(spark, name)
    middle = weeks.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY year)").alias("y"))
    split = with_row(weeks, middle)
    late = F.col("year") > F.col("y")
    first = split.withColumn("sales", F.when(late, F.col("sales") * 2).otherwise(F.col("sales")).cast("decimal(38,6)")).drop("y")
    write_store_weeks(first, name, path, buckets=8)
    write_store_weeks(split.where(late).drop("y"), name, path, buckets=8)
    return store_years(spark, name)


# ---- the whole bundle over cleaned and filtered rows

BUNDLE_FILTER = {"region": "ASIA", "store": "All"}
_FILTERED_CTE = "kept AS (SELECT * FROM clean WHERE region = 'ASIA')"


def _over_kept(sql: str) -> str:
    """A query over the fact, asked of the kept rows."""
    return re.sub(r"\b(FROM|JOIN) fact\b", r"\1 kept", sql)


def _bundle_sql(sql: str, *ctes: str) -> str:
    return with_fact(_over_kept(sql), DIRTY_CTE, TYPED_CTE, CLEAN_CTE, _FILTERED_CTE, *[_over_kept(c) for c in ctes])


def _bundle(spark, sf, output: str):
    return compute_kpis(dirty_fact(spark, sf), fact_rules(), filters=BUNDLE_FILTER, ties=TIES, outputs=[output])[output]


@register("bundle_stores", _bundle_sql("""
SELECT store, CAST(sum(weekly_sales) AS DOUBLE) AS total_sales, CAST(sum(transactions) AS DOUBLE) AS transactions,
       round(any_value(tr.trend), 6) AS trend, round(avg(atv), 6) AS avg_transaction_value,
       round(avg(eff), 6) AS efficiency_pct, round(any_value(lw.lw), 6) AS week_over_week_pct
FROM der2 JOIN tr USING (store) LEFT JOIN lw USING (store) GROUP BY store""", DERIVED_CTE, tail_cte("store", "tr"),
    f"""lw AS (SELECT store, wow_pct AS lw FROM (
          SELECT store, wow_pct, row_number() OVER (PARTITION BY store ORDER BY {ORDER_DESC_SQL}) AS rn
          FROM der WHERE wow_pct IS NOT NULL) WHERE rn = 1)"""))
def q_bundle_stores(spark, sf):
    return _bundle(spark, sf, "stores")


@register("bundle_stores_meta", _bundle_sql("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM t) AS store_count,
       (SELECT store FROM t ORDER BY s DESC, store LIMIT 1) AS top_store,
       (SELECT CAST(s AS DOUBLE) FROM t ORDER BY s DESC, store LIMIT 1) AS top_store_sales,
       (SELECT store FROM t ORDER BY s ASC, store LIMIT 1) AS bottom_store,
       (SELECT CAST(s AS DOUBLE) FROM t ORDER BY s ASC, store LIMIT 1) AS bottom_store_sales""",
    "t AS (SELECT store, sum(weekly_sales) AS s FROM fact WHERE store IS NOT NULL GROUP BY store)"))
def q_bundle_stores_meta(spark, sf):
    return _bundle(spark, sf, "stores_meta")


@register("bundle_regional", _bundle_sql("""
SELECT region, CAST(sum(weekly_sales) AS DOUBLE) AS sales, CAST(sum(transactions) AS DOUBLE) AS transactions,
       round(coalesce(any_value(rt.trend), 0.0), 6) AS trend_4wk,
       round(CASE WHEN sum(transactions) > 0 THEN CAST(sum(weekly_sales) AS DOUBLE) / CAST(sum(transactions) AS DOUBLE)
                  ELSE 0.0 END, 6) AS avg_transaction_value
FROM fact JOIN rt USING (region) GROUP BY region""", tail_cte("region", "rt")))
def q_bundle_regional(spark, sf):
    return _bundle(spark, sf, "regional")


@register("bundle_departments", _bundle_sql(DEPT_SQL, tail_cte("department", "dt", null_default=True)))
def q_bundle_departments(spark, sf):
    return _bundle(spark, sf, "departments")


@register("bundle_departments_meta", _bundle_sql("""
SELECT CAST(count(*) FILTER (WHERE cumulative_pct <= 80) AS BIGINT) AS pareto_80_count,
       CAST(count(*) AS BIGINT) AS total_count FROM dm""", tail_cte("department", "dt", null_default=True), "dm AS (" + DEPT_RAW_SQL + ")"))
def q_bundle_departments_meta(spark, sf):
    return _bundle(spark, sf, "departments_meta")


@register("bundle_flagged_rows", _bundle_sql("""
SELECT date, store, department, l_orderkey, l_linenumber, CAST(weekly_sales AS DOUBLE) AS weekly_sales, transactions, is_outlier,
       wow_pct, atv AS avg_transaction_value, round(eff, 6) AS store_efficiency_pct,
       CAST(weekly_sales AS DOUBLE) / nullif(CAST(day_total AS DOUBLE), 0) * 100 AS revenue_contribution_pct
FROM flagged""", DERIVED_CTE, *_iqr_ctes("der2")))
def q_bundle_flagged_rows(spark, sf):
    d = _bundle(spark, sf, "flagged_rows")
    return d.select("date", "store", "department", *TIES, F.col("weekly_sales").cast("double").alias("weekly_sales"), "transactions", "is_outlier",
                    "wow_pct", "avg_transaction_value", F.round("store_efficiency_pct", 6).alias("store_efficiency_pct"), "revenue_contribution_pct")


@register("bundle_daily", _bundle_sql("""
SELECT date, CAST(sum(weekly_sales) AS DOUBLE) AS weekly_sales_sum, CAST(sum(transactions) AS DOUBLE) AS transactions_sum FROM fact GROUP BY date"""))
def q_bundle_daily(spark, sf):
    """A1 by day: days that have rows (the dense series adds empty days)."""
    rules = fact_rules()
    rules["kpis"]["time_freq"] = "D"
    d = compute_kpis(dirty_fact(spark, sf), rules, filters=BUNDLE_FILTER, ties=TIES, outputs=["kpis_weekly"])["kpis_weekly"]
    return d.where("transactions_sum > 0 OR weekly_sales_sum > 0").select("date", "weekly_sales_sum", F.col("transactions_sum").cast("double"))


@register("bundle_monthly", _bundle_sql("""
SELECT last_day(date) AS date, CAST(sum(weekly_sales) AS DOUBLE) AS weekly_sales_sum, CAST(sum(transactions) AS DOUBLE) AS transactions_sum FROM fact GROUP BY 1"""))
def q_bundle_monthly(spark, sf):
    """A1 by month, labelled by the month's last day."""
    rules = fact_rules()
    rules["kpis"]["time_freq"] = "M"
    d = compute_kpis(dirty_fact(spark, sf), rules, filters=BUNDLE_FILTER, ties=TIES, outputs=["kpis_weekly"])["kpis_weekly"]
    return d.select("date", "weekly_sales_sum", F.col("transactions_sum").cast("double"))


@register("zero_policy_fact", with_fact("""
SELECT date, store, CAST(coalesce(weekly_sales, 0) AS DOUBLE) AS weekly_sales, transactions, l_orderkey, l_linenumber
FROM clipped""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE))
def q_zero_policy(spark, sf):
    """Missing amounts become zero; nothing else is filled or dropped."""
    rules = fact_rules()
    rules["cleaning"]["null_policy"] = {"weekly_sales": "zero"}
    d = C.clean(dirty_fact(spark, sf), rules)
    return d.select("date", "store", F.col("weekly_sales").cast("double").alias("weekly_sales"), "transactions", *TIES)
