"""Weekly series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import weekly as wk
from ..operators.derive import prep_common
from ..sources.rules import fact_rules
from ..sources.tables import fact_view
from .catalog import WEEKLY_CTE, register, with_fact


@register("weekly_kpis", with_fact("""
SELECT date, CAST(s AS DOUBLE) AS weekly_sales_sum, CAST(t AS DOUBLE) AS transactions_sum,
       round(wow, 6) AS wow_growth_pct, round(ma4, 6) AS ma_4wk
FROM growth""", WEEKLY_CTE))
def q_weekly_kpis(spark, sf):
    return wk.weekly_kpis(fact_view(spark, sf))


@register("weekly_trend", with_fact("""
SELECT round(CASE WHEN count(*) >= 8 AND avg(CASE WHEN k BETWEEN 5 AND 8 THEN sd END) > 0 THEN
         (avg(CASE WHEN k <= 4 THEN sd END) - avg(CASE WHEN k BETWEEN 5 AND 8 THEN sd END))
         / avg(CASE WHEN k BETWEEN 5 AND 8 THEN sd END) END, 6) AS trend_4wk,
       round(max(CASE WHEN k = 1 THEN wow END), 6) AS wow_last,
       CAST(count(*) AS BIGINT) AS weeks
FROM growth""", WEEKLY_CTE))
def q_weekly_trend(spark, sf):
    return wk.weekly_trend(fact_view(spark, sf))


@register("last4_weeks", with_fact("""
SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS last4_sales,
       CAST(coalesce(sum(t), 0) AS BIGINT) AS last4_transactions,
       round(CAST(coalesce(sum(s), 0) AS DOUBLE) / 4, 6) AS avg_sales_per_week,
       round(CAST(coalesce(sum(t), 0) AS DOUBLE) / 4, 6) AS avg_transactions_per_week,
       round(CAST(coalesce(sum(s), 0) AS DOUBLE) / nullif(CAST(sum(t) AS DOUBLE), 0), 6) AS avg_transaction_value
FROM growth WHERE k <= 4""", WEEKLY_CTE))
def q_last4(spark, sf):
    return wk.last_periods_totals(fact_view(spark, sf))


@register("ma_trend", with_fact("""
SELECT round(coalesce(CASE WHEN count(*) >= 4 AND max(CASE WHEN k = 4 THEN ma4 END) <> 0 THEN
   (max(CASE WHEN k = 1 THEN ma4 END) - max(CASE WHEN k = 4 THEN ma4 END))
   / max(CASE WHEN k = 4 THEN ma4 END) * 100 END, 0.0), 6) AS trend_4wk_pct
FROM growth""", WEEKLY_CTE))
def q_ma_trend(spark, sf):
    return wk.ma_trend_pct(fact_view(spark, sf))


@register("wow_stats", with_fact("""
SELECT round(coalesce(max(CASE WHEN k = 1 THEN wow * 100 END), 0.0), 6) AS last_wow_pct,
       round(coalesce(avg(wow * 100), 0.0), 6) AS avg_wow_pct,
       CAST(count(*) FILTER (WHERE sd > prev) AS BIGINT) AS pos_weeks,
       CAST(count(*) FILTER (WHERE sd < prev) AS BIGINT) AS neg_weeks
FROM p""", WEEKLY_CTE, "p AS (SELECT *, lag(sd) OVER (ORDER BY date) AS prev FROM growth)"))
def q_wow_stats(spark, sf):
    return wk.wow_stats(fact_view(spark, sf))


@register("momentum", with_fact("""
SELECT round(cur, 6) AS current_value, round(prev, 6) AS previous_value,
       round(cur - prev, 6) AS change_amount,
       round(CASE WHEN prev > 0 THEN (cur - prev) / prev * 100 ELSE 0.0 END, 6) AS change_pct,
       round(avg4, 6) AS four_week_avg,
       CASE WHEN cur > avg4 THEN 'above' ELSE 'below' END AS vs_four_week_avg,
       round(std, 6) AS volatility,
       CASE WHEN abs(cur - prev) > abs(CASE WHEN n > 4 THEN prev - four ELSE 0.0 END)
            THEN 'accelerating' ELSE 'slowing' END AS velocity,
       CAST(n AS BIGINT) AS data_points
FROM b""", WEEKLY_CTE, """a AS (
  SELECT count(*) AS n, max(CASE WHEN k = 1 THEN sd END) AS cur,
         max(CASE WHEN k = 2 THEN sd END) AS prev0, max(CASE WHEN k = 5 THEN sd END) AS p5,
         avg(CASE WHEN k <= 4 THEN sd END) AS avg4, stddev_samp(sd) AS std FROM growth)""",
    """b AS (SELECT *, CASE WHEN n > 1 THEN prev0 ELSE cur END AS prev,
       CASE WHEN n > 4 THEN p5 ELSE cur END AS four FROM a)"""))
def q_momentum(spark, sf):
    return wk.momentum(fact_view(spark, sf))


@register("weekly_stats", with_fact("""
SELECT c.date, CAST(coalesce(w.s, 0) AS DOUBLE) AS weekly_sales_sum,
       CAST(coalesce(w.t, 0) AS DOUBLE) AS transactions_sum,
       round(w.m, 6) AS weekly_sales_mean, round(w.sdv, 6) AS weekly_sales_std,
       round(w.tm, 6) AS transactions_mean,
       round(CAST(coalesce(w.s, 0) AS DOUBLE) / nullif(CAST(coalesce(w.t, 0) AS DOUBLE), 0), 6) AS avg_order_value,
       round(w.sdv / nullif(w.m, 0), 6) AS sales_volatility
FROM cal c LEFT JOIN wk2 w ON c.date = w.date""", """wk2 AS (
  SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS date, sum(weekly_sales) AS s,
         sum(transactions) AS t, CAST(sum(weekly_sales) AS DOUBLE) / count(weekly_sales) AS m,
         stddev_samp(CAST(weekly_sales AS DOUBLE)) AS sdv, CAST(sum(transactions) AS DOUBLE) / count(transactions) AS tm
  FROM fact GROUP BY 1)""", """cal AS (
  SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP),
                                     INTERVAL 7 DAY)) AS DATE) AS date FROM wk2)"""))
def q_weekly_stats(spark, sf):
    return wk.weekly_stats(fact_view(spark, sf), fact_rules())


@register("weekly_wow_class", with_fact("""
SELECT date, round(wow, 6) AS wow_growth_pct,
       CASE WHEN coalesce(wow, 0.0) >= 0 THEN 'up' ELSE 'down' END AS wow_class
FROM growth""", WEEKLY_CTE))
def q_weekly_wow_class(spark, sf):
    growth = wk.with_growth(wk.weekly_dense(fact_view(spark, sf)))
    return wk.wow_sign_class(growth).select("date", F.round("wow_growth_pct", 6).alias("wow_growth_pct"), "wow_class")


@register("dense_series_transactions", with_fact("""
SELECT date, CAST(t AS DOUBLE) AS transactions_sum FROM dense""", WEEKLY_CTE))
def q_dense_series(spark, sf):
    d = wk.dense_series(fact_view(spark, sf), "transactions")
    return d.select("date", F.col("transactions_sum").cast("double").alias("transactions_sum"))


@register("prep_common", with_fact("""
SELECT l_orderkey, l_linenumber, CAST(weekly_sales AS DOUBLE) AS sales, CAST(NULL AS DOUBLE) AS profit,
       CAST(NULL AS DOUBLE) AS quantity, CAST(year(date) AS INTEGER) AS year,
       CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS week
FROM fact"""))
def q_prep_common(spark, sf):
    p = prep_common(fact_view(spark, sf))
    return p.select("l_orderkey", "l_linenumber", F.col("sales").cast("double").alias("sales"),
                    "profit", "quantity", "year", "month", "week")


@register("weekly_rule_aggregates", with_fact("""
SELECT c.date, coalesce(s, 0.0) AS weekly_sales_sum, round(m, 6) AS weekly_sales_mean, round(sd, 6) AS weekly_sales_std, mx AS weekly_sales_max,
       coalesce(ts, 0.0) AS transactions_sum, CAST(coalesce(tn, 0) AS BIGINT) AS transactions_count, coalesce(u, 0.0) AS units_sold_sum,
       round(s / nullif(ts, 0), 6) AS avg_order_value, round(sd / nullif(m, 0), 6) AS sales_volatility
FROM cal c LEFT JOIN (
  SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS date, CAST(sum(weekly_sales) AS DOUBLE) AS s,
         CAST(sum(weekly_sales) AS DOUBLE) / count(weekly_sales) AS m, stddev_samp(CAST(weekly_sales AS DOUBLE)) AS sd, CAST(max(weekly_sales) AS DOUBLE) AS mx,
         CAST(sum(transactions) AS DOUBLE) AS ts, count(transactions) AS tn, CAST(sum(l_linenumber) AS DOUBLE) AS u
  FROM fact WHERE date IS NOT NULL GROUP BY 1) a ON a.date = c.date""", WEEKLY_CTE))
def q_weekly_rule_aggregates(spark, sf):
    """kpis.aggregates and optional_columns of the rules: what a rules file lists is what comes out."""
    rules = fact_rules()
    rules["kpis"]["aggregates"] = {"weekly_sales": ["sum", "mean", "std", "max"], "transactions": ["sum", "count"], "not_there": ["sum"]}
    f = fact_view(spark, sf).withColumn("units_sold", F.col("l_linenumber"))
    w = wk.rule_aggregates(f, rules)
    rounded = ("weekly_sales_mean", "weekly_sales_std", "avg_order_value", "sales_volatility")
    return w.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in w.columns])
