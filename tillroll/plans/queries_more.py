"""Trend, benchmark, efficiency and findings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import money, r6
from ..operators import benchmark as B
from ..operators import clean as C
from ..operators import efficiency as EF
from ..operators import entities as E
from ..operators import entity_findings as EFD
from ..operators import findings as FD
from ..operators import outliers as O
from ..operators import quality as Q
from ..operators import trends as T
from ..operators import weekly as wk
from ..sources.rules import fact_rules
from ..sources.tables import dirty_fact, fact_view
from .catalog import WEEKLY_CTE, register, with_fact
from .queries_clean import CLEAN_CTE, DIRTY_CTE, TYPED_CTE, _iqr_ctes
from .queries_entities import DEPT_RAW_SQL, TIES, tail_cte
from ..functions.scalar import one_row, with_row


def week_cte(entity: str, name: str) -> str:
    return f"""{name} AS (
  SELECT {entity}, CAST(date_trunc('week', date) AS DATE) + 6 AS date, sum(weekly_sales) AS sales
  FROM fact WHERE date IS NOT NULL AND {entity} IS NOT NULL AND weekly_sales IS NOT NULL GROUP BY 1, 2)"""


for _ent in ("store", "region", "department"):
    def _mk(ent):
        @register(f"{ent}_week_sums", with_fact(f"SELECT {ent}, date, CAST(sales AS DOUBLE) AS sales FROM ew",
                                                week_cte(ent, "ew")))
        def q(spark, sf):
            return T.week_sums_report(fact_view(spark, sf), ent)
        return q
    _mk(_ent)


ALIGNED_SQL = """SELECT store, CAST(l4 AS DOUBLE) AS last_4w, CAST(coalesce(p4, 0) AS DOUBLE) AS prev_4w,
       CASE WHEN coalesce(p4, 0) > 0 THEN (CAST(l4 AS DOUBLE) - CAST(coalesce(p4, 0) AS DOUBLE))
            / CAST(coalesce(p4, 0) AS DOUBLE) END AS change
FROM (SELECT store, sum(sales) FILTER (WHERE date > lw - 28 AND date <= lw) AS l4,
             sum(sales) FILTER (WHERE date > lw - 56 AND date <= lw - 28) AS p4,
             count(*) FILTER (WHERE date > lw - 28 AND date <= lw) AS nl
      FROM sw, (SELECT max(date) AS lw FROM sw) m GROUP BY store) WHERE nl > 0"""


@register("store_4wk_aligned", with_fact(ALIGNED_SQL, week_cte("store", "sw")))
def q_store_4wk_aligned(spark, sf):
    return T.store_4wk_aligned(fact_view(spark, sf))


@register("store_4wk_own_tail", with_fact("""
SELECT store, CAST(round_even(l4, 0) AS BIGINT) AS last_4w_rounded, CAST(round_even(p4, 0) AS BIGINT) AS prev_4w_rounded,
       CASE WHEN p4 <> 0 THEN (l4 - p4) / p4 END AS pct_change,
       CASE WHEN p4 <> 0 THEN printf('%+.1f%%', round_even((l4 - p4) / p4 * 100, 1)) ELSE '' END AS change_text
FROM b""", week_cte("store", "sw"),
    "t AS (SELECT store, sales, row_number() OVER (PARTITION BY store ORDER BY date DESC) AS rn FROM sw)",
    """a AS (SELECT store, count(*) AS n, sum(sales) FILTER (WHERE rn <= 4) AS l4, sum(sales) FILTER (WHERE rn > 4) AS p4
       FROM t WHERE rn <= 8 GROUP BY store)""",
    """b AS (SELECT store, CAST(coalesce(l4, 0) AS DOUBLE) AS l4,
              CAST(CASE WHEN n >= 5 THEN coalesce(p4, 0) ELSE 0 END AS DOUBLE) AS p4 FROM a)"""))
def q_store_4wk_own_tail(spark, sf):
    return T.store_4wk_own_tail(fact_view(spark, sf))


@register("store_4wk_rolling", with_fact("""
SELECT store, date, CAST(l4 AS DOUBLE) AS last_4w, CAST(p4 AS DOUBLE) AS prev_4w,
       (CAST(l4 AS DOUBLE) - CAST(p4 AS DOUBLE)) / nullif(CAST(p4 AS DOUBLE), 0) AS delta
FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY date DESC) AS k FROM r WHERE nl = 4 AND np = 4)
WHERE k = 1""", week_cte("store", "sw"), """r AS (
  SELECT store, date,
         sum(sales) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l4,
         count(*) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS nl,
         sum(sales) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) AS p4,
         count(*) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) AS np
  FROM sw)"""))
def q_store_4wk_rolling(spark, sf):
    return T.store_4wk_rolling(fact_view(spark, sf))


@register("region_last_week_growth", with_fact("""
SELECT region, date, CAST(sales AS DOUBLE) AS weekly_sales,
       (CAST(sales AS DOUBLE) - CAST(prev AS DOUBLE)) / nullif(CAST(prev AS DOUBLE), 0) * 100 AS growth
FROM (SELECT region, date, sales, lag(sales) OVER (PARTITION BY region ORDER BY date) AS prev,
             row_number() OVER (PARTITION BY region ORDER BY date DESC) AS k FROM rw) WHERE k = 1""",
    week_cte("region", "rw")))
def q_region_last_week_growth(spark, sf):
    return T.region_last_week_growth(fact_view(spark, sf))


@register("store_pulse", with_fact("""
SELECT CAST(count(*) FILTER (WHERE change > 0) AS BIGINT) AS stores_growing,
       CAST(count(*) FILTER (WHERE change < 0) AS BIGINT) AS stores_declining,
       (SELECT store FROM al WHERE change IS NOT NULL ORDER BY change DESC, store LIMIT 1) AS best_store,
       (SELECT change * 100 FROM al WHERE change IS NOT NULL ORDER BY change DESC, store LIMIT 1) AS best_growth_pct,
       (SELECT store FROM al WHERE change IS NOT NULL ORDER BY change ASC, store LIMIT 1) AS worst_store,
       (SELECT change * 100 FROM al WHERE change IS NOT NULL ORDER BY change ASC, store LIMIT 1) AS worst_decline_pct
FROM al""", week_cte("store", "sw"), "al AS (" + ALIGNED_SQL + ")"))
def q_store_pulse(spark, sf):
    return T.store_pulse(T.store_4wk_aligned(fact_view(spark, sf)))


# ------------------------------------------------------------- benchmarks

def cat_ctes(cat: str) -> list[str]:
    return [f"""s AS (SELECT {cat} AS cat, sum(weekly_sales) AS v FROM fact
              WHERE weekly_sales IS NOT NULL AND {cat} IS NOT NULL GROUP BY {cat})""",
            "m AS (SELECT CAST(sum(v) AS DOUBLE) / count(*) AS avg, sum(v) AS total FROM s)"]


for _cat in ("store", "department", "region"):
    def _mkb(cat):
        @register(f"benchmark_{cat}", with_fact(f"""
SELECT cat AS {cat}, CAST(v AS DOUBLE) AS value, avg, CAST(v AS DOUBLE) >= avg AS above_avg,
       CAST(v AS DOUBLE) - avg AS variance,
       CASE WHEN avg = 0 THEN 0.0 ELSE (CAST(v AS DOUBLE) - avg) / avg END AS variance_pct
FROM s, m""", *cat_ctes(cat)))
        def q(spark, sf):
            return B.benchmark(fact_view(spark, sf), cat)
        return q
    _mkb(_cat)


for _cat in ("store", "department"):
    def _mkc(cat):
        @register(f"benchmark_context_{cat}", with_fact("""
SELECT avg AS avg_sales, (SELECT cat FROM s ORDER BY v DESC, cat LIMIT 1) AS top,
       (SELECT cat FROM s ORDER BY v ASC, cat LIMIT 1) AS bottom,
       CAST((SELECT count(*) FROM s WHERE CAST(v AS DOUBLE) < m.avg) AS BIGINT) AS below_avg_count,
       CASE WHEN avg <> 0 THEN (avg - (SELECT CAST(v AS DOUBLE) FROM s ORDER BY v ASC, cat LIMIT 1)) / avg * 100
            ELSE 0.0 END AS bottom_gap_pct
FROM m""", *cat_ctes(cat)))
        def q(spark, sf):
            return B.benchmark_context(fact_view(spark, sf), cat)

        @register(f"benchmark_split_{cat}", with_fact("""
SELECT CAST(count(*) AS BIGINT) AS num,
       CAST(count(*) FILTER (WHERE CAST(v AS DOUBLE) > avg) AS BIGINT) AS above_avg,
       CAST(count(*) FILTER (WHERE NOT (CAST(v AS DOUBLE) > avg)) AS BIGINT) AS below_avg,
       (SELECT cat FROM s, m WHERE CAST(v AS DOUBLE) > avg ORDER BY v DESC, cat LIMIT 1) AS top,
       coalesce((SELECT CAST(v AS DOUBLE) FROM s, m WHERE CAST(v AS DOUBLE) > avg ORDER BY v DESC, cat LIMIT 1), 0.0) AS top_sales,
       (SELECT cat FROM s, m WHERE CAST(v AS DOUBLE) <= avg ORDER BY v ASC, cat LIMIT 1) AS bottom,
       coalesce((SELECT CAST(v AS DOUBLE) FROM s, m WHERE CAST(v AS DOUBLE) <= avg ORDER BY v ASC, cat LIMIT 1), 0.0) AS bottom_sales,
       any_value(avg) AS avg_sales
FROM s, m""", *cat_ctes(cat)))
        def q2(spark, sf):
            return B.benchmark_split(fact_view(spark, sf), cat)
        return q, q2
    _mkc(_cat)


for _cat, _n in (("region", 3), ("department", 5)):
    def _mks(cat, n):
        @register(f"share_top{n}_{cat}", with_fact(f"""
SELECT cat AS {cat}, CAST(v AS DOUBLE) AS value, CAST(rank AS BIGINT) AS rank,
       CASE WHEN total = 0 THEN 0.0 ELSE CAST(v AS DOUBLE) / CAST(total AS DOUBLE) END AS share
FROM r, m WHERE rank <= {n}
UNION ALL
SELECT 'Others', CAST(sum(v) AS DOUBLE), CAST({n + 1} AS BIGINT),
       CAST(sum(v) AS DOUBLE) / CAST(any_value(total) AS DOUBLE)
FROM r, m WHERE rank > {n} HAVING sum(v) > 0 AND any_value(total) <> 0""",
            *cat_ctes(cat), "r AS (SELECT cat, v, row_number() OVER (ORDER BY v DESC, cat) AS rank FROM s)"))
        def q(spark, sf):
            return B.share_top_n(fact_view(spark, sf), cat, n=n)
        return q
    _mks(_cat, _n)


DM_CTES = [tail_cte("department", "dt", null_default=True), "dm AS (" + DEPT_RAW_SQL + ")"]


@register("pareto_cut", with_fact("""
SELECT department, rank, round(cumulative_pct, 6) AS cumulative_pct FROM (
  SELECT department, rank, cumulative_pct, 0 AS pri FROM dm WHERE cumulative_pct >= 80
  UNION ALL SELECT department, rank, cumulative_pct, 1 AS pri FROM dm)
ORDER BY pri, CASE WHEN pri = 0 THEN rank ELSE -rank END LIMIT 1""", *DM_CTES))
def q_pareto_cut(spark, sf):
    return B.pareto_cut(E.department_metrics(fact_view(spark, sf), ties=TIES, rounded=False)).withColumn("cumulative_pct", r6("cumulative_pct"))


@register("region_concentration", with_fact("""
SELECT round(max(CAST(s AS DOUBLE)) * 100 / sum(CAST(s AS DOUBLE)), 6) AS top_region_contribution_pct,
       round(min(CAST(s AS DOUBLE)) * 100 / max(CAST(s AS DOUBLE)), 6) AS regional_balance
FROM (SELECT region, sum(weekly_sales) AS s FROM fact WHERE region IS NOT NULL GROUP BY region)"""))
def q_region_concentration(spark, sf):
    c = B.region_concentration(E.region_metrics(fact_view(spark, sf), ties=TIES))
    return c.select(*[r6(x).alias(x) for x in c.columns])


@register("department_concentration", with_fact("""
SELECT round(CASE WHEN sum(sales) > 0 THEN max(sales) / sum(sales) * 100 ELSE 0.0 END, 6) AS top_dept_share,
       round(max(sales) FILTER (WHERE sales > 0) * 100 / sum(sales) FILTER (WHERE sales > 0), 6) AS dept_concentration_pct,
       CAST(count(*) FILTER (WHERE cumulative_pct <= 80) AS BIGINT) AS pareto_80_count,
       CASE WHEN sum(sales) > 0 THEN CASE WHEN count(*) FILTER (WHERE cumulative_pct <= 80) <= 3 THEN 'high'
            WHEN count(*) FILTER (WHERE cumulative_pct <= 80) <= 5 THEN 'moderate' ELSE 'balanced' END END AS concentration_level,
       round(count(*) FILTER (WHERE cumulative_pct <= 80) * 100.0 / count(*), 6) AS top_80_pct_of_departments
FROM dm""", *DM_CTES))
def q_department_concentration(spark, sf):
    c = B.department_concentration(E.department_metrics(fact_view(spark, sf), ties=TIES, rounded=False))
    return c.select(*[r6(x).alias(x) if x not in ("pareto_80_count", "concentration_level") else F.col(x)
                      for x in c.columns])


@register("top3_departments", with_fact("""
SELECT rank, department, sales, round(sales * 100 / (SELECT sum(sales) FROM dm), 6) AS contribution_pct,
       round(coalesce(trend_4wk, 0.0) * 100, 6) AS trend_pct
FROM dm WHERE rank <= 3""", *DM_CTES))
def q_top3_departments(spark, sf):
    t = B.top_departments(E.department_metrics(fact_view(spark, sf), ties=TIES), 3)
    return t.select("rank", "department", "sales", r6("contribution_pct").alias("contribution_pct"),
                    r6("trend_pct").alias("trend_pct"))


@register("top10_departments", with_fact("""
SELECT department, CAST(sum(weekly_sales) AS DOUBLE) AS sales FROM fact WHERE department IS NOT NULL
GROUP BY department ORDER BY sum(weekly_sales) DESC, department LIMIT 10"""))
def q_top10_departments(spark, sf):
    t = E.entity_totals(fact_view(spark, sf), "department", txns=None)
    return E.top_n(t, "department", "sales", 10).select("department", money("sales").alias("sales"))


# ------------------------------------------------------------- efficiency

A11_SQL = """SELECT store, region, CAST(sum(weekly_sales) AS DOUBLE) AS sales, CAST(sum(transactions) AS DOUBLE) AS txns,
       CAST(sum(weekly_sales) AS DOUBLE) / greatest(CAST(sum(transactions) AS DOUBLE), 1.0) AS value_per_txn
FROM fact GROUP BY store, region"""


@register("efficiency_store_region", with_fact(A11_SQL))
def q_eff_store_region(spark, sf):
    return EF.store_region_efficiency(fact_view(spark, sf))


@register("efficiency_quadrants", with_fact("""
SELECT store, region, value_per_txn, txns, round(mx, 6) AS median_x, round(my, 6) AS median_y,
       (CASE WHEN value_per_txn >= mx THEN 'high' ELSE 'low' END) || '_value_per_txn_'
       || (CASE WHEN txns >= my THEN 'high' ELSE 'low' END) || '_txns' AS quadrant
FROM a, (SELECT quantile_cont(value_per_txn, 0.5) AS mx, quantile_cont(txns, 0.5) AS my FROM a) q""",
    "a AS (" + A11_SQL + ")"))
def q_eff_quadrants(spark, sf):
    t = EF.store_region_efficiency(fact_view(spark, sf))
    q = EF.quadrants(t, "value_per_txn", "txns", ["store", "region"])
    return q.withColumn("median_x", r6("median_x")).withColumn("median_y", r6("median_y"))


@register("efficiency_store", with_fact("""
SELECT store, CAST(sum(weekly_sales) AS DOUBLE) AS sales, CAST(sum(transactions) AS DOUBLE) AS transactions,
       CAST(sum(weekly_sales) AS DOUBLE) / nullif(CAST(sum(transactions) AS DOUBLE), 0) AS avg_transaction_value
FROM fact WHERE store IS NOT NULL GROUP BY store"""))
def q_eff_store(spark, sf):
    return EF.store_efficiency(fact_view(spark, sf))


@register("efficiency_regression", with_fact("""
SELECT round(CASE WHEN count(*) >= 2 THEN coalesce(regr_slope(sales, txns), 0.0) ELSE 0.0 END, 6) AS slope,
       round(CASE WHEN count(*) >= 2 THEN coalesce(regr_intercept(sales, txns), 0.0) ELSE 0.0 END, 6) AS intercept,
       round(CASE WHEN count(*) >= 2 AND var_pop(sales) <> 0 THEN coalesce(regr_r2(sales, txns), 0.0) ELSE 0.0 END, 6) AS r2,
       CAST(count(*) AS BIGINT) AS points
FROM a""", "a AS (" + A11_SQL + ")"))
def q_eff_regression(spark, sf):
    r = EF.regression(EF.store_region_efficiency(fact_view(spark, sf)), "txns", "sales")
    return r.select(r6("slope").alias("slope"), r6("intercept").alias("intercept"), r6("r2").alias("r2"), "points")


@register("yoy_delta", with_fact("""
SELECT CAST(cy AS BIGINT) AS current_year, CAST(coalesce(cur, 0) AS DOUBLE) AS current_total,
       CAST(coalesce(py, 0) AS DOUBLE) AS prior_total,
       CASE WHEN npy = 0 OR coalesce(py, 0) = 0 THEN 0.0
            ELSE (CAST(cur AS DOUBLE) - CAST(py AS DOUBLE)) / CAST(py AS DOUBLE) END AS delta
FROM (SELECT any_value(cy) AS cy, sum(weekly_sales) FILTER (WHERE year(date) = cy) AS cur,
             sum(weekly_sales) FILTER (WHERE year(date) = cy - 1) AS py,
             count(*) FILTER (WHERE year(date) = cy - 1) AS npy
      FROM fact, (SELECT max(year(date)) AS cy FROM fact WHERE date IS NOT NULL AND weekly_sales IS NOT NULL) y
      WHERE date IS NOT NULL AND weekly_sales IS NOT NULL)"""))
def q_yoy(spark, sf):
    return EF.yoy_delta(fact_view(spark, sf))


@register("efficiency_metrics", with_fact("""
SELECT CAST(sum(weekly_sales) AS DOUBLE) AS total_sales,
       CAST(sum(weekly_sales) AS DOUBLE) / CAST(count(weekly_sales) AS DOUBLE) AS avg_transaction_value,
       CAST(count(DISTINCT store) AS BIGINT) AS active_stores,
       CAST(sum(weekly_sales) AS DOUBLE) / CAST(count(DISTINCT store) AS DOUBLE) AS sales_per_store,
       coalesce(CAST(sum(transactions) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE) * 100, 0.0) AS capacity_utilization
FROM fact"""))
def q_eff_metrics(spark, sf):
    return EF.efficiency_metrics(fact_view(spark, sf))


# ------------------------------------------------------------- findings / exec

HEALTH_SQL = """CASE WHEN tr IS NULL THEN 'Inconclusive' WHEN tr >= 0.05 AND o <= 5 THEN 'Healthy'
                     WHEN tr >= 0.0 THEN 'Watch' ELSE 'Declining' END"""

TREND_SQL = """(SELECT CASE WHEN count(*) >= 8 AND avg(CASE WHEN k BETWEEN 5 AND 8 THEN sd END) > 0 THEN
         (avg(CASE WHEN k <= 4 THEN sd END) - avg(CASE WHEN k BETWEEN 5 AND 8 THEN sd END))
         / avg(CASE WHEN k BETWEEN 5 AND 8 THEN sd END) END FROM growth)"""


def _health_frame(spark, sf):
    f = fact_view(spark, sf)
    tr = wk.weekly_trend(f, rounded=False).select("trend_4wk")
    oc = O.outlier_count(f, value="weekly_sales", group_by="store", k=1.5)
    return with_row(tr, oc)


@register("health_status", with_fact(f"""
SELECT round(tr, 6) AS trend_4wk, o AS outliers, {HEALTH_SQL} AS health
FROM (SELECT {TREND_SQL} AS tr, (SELECT CAST(count(*) FILTER (WHERE is_outlier) AS BIGINT) FROM flagged) AS o)""",
    WEEKLY_CTE, *_iqr_ctes("fact")))
def q_health(spark, sf):
    h = _health_frame(spark, sf)
    return h.select(r6("trend_4wk").alias("trend_4wk"), "outliers", FD.health_status(F.col("trend_4wk"), F.col("outliers")).alias("health"))


@register("executive_kpis", with_fact(f"""
SELECT CAST(l.s AS DOUBLE) AS total_revenue, CAST(l.t AS BIGINT) AS total_transactions,
       CASE WHEN l.t > 0 THEN CAST(l.s AS DOUBLE) / CAST(l.t AS DOUBLE) ELSE 0.0 END AS avg_transaction_value,
       round(coalesce(h.tr * 100, 0.0), 6) AS trend_4wk_pct,
       {HEALTH_SQL.replace('tr ', 'h.tr ').replace(' o ', ' h.o ')} AS health_status,
       (SELECT store FROM st ORDER BY v DESC, store LIMIT 1) AS top_store,
       (SELECT CAST(v AS DOUBLE) FROM st ORDER BY v DESC, store LIMIT 1) AS top_store_sales,
       (SELECT store FROM st ORDER BY v ASC, store LIMIT 1) AS bottom_store,
       (SELECT CAST(v AS DOUBLE) FROM st ORDER BY v ASC, store LIMIT 1) AS bottom_store_sales,
       (SELECT CAST(count(*) AS BIGINT) FROM st) AS store_count
FROM (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM growth WHERE k <= 4) l,
     (SELECT {TREND_SQL} AS tr, (SELECT count(*) FILTER (WHERE is_outlier) FROM flagged) AS o) h""",
    WEEKLY_CTE, *_iqr_ctes("fact"),
    "st AS (SELECT store, sum(weekly_sales) AS v FROM fact WHERE store IS NOT NULL GROUP BY store)"))
def q_executive(spark, sf):
    f = fact_view(spark, sf)
    l4 = wk.last_periods_totals(f).select("last4_sales", "last4_transactions")
    h = _health_frame(spark, sf)
    s = E.store_summary(f)
    j = one_row(l4, h, s)
    atv = F.when(F.col("last4_transactions") > 0,
                 F.col("last4_sales") / F.col("last4_transactions").cast("double")).otherwise(F.lit(0.0))
    return j.select(F.col("last4_sales").alias("total_revenue"), F.col("last4_transactions").alias("total_transactions"),
                    atv.alias("avg_transaction_value"),
                    r6(F.coalesce(F.col("trend_4wk") * 100, F.lit(0.0))).alias("trend_4wk_pct"),
                    FD.health_status(F.col("trend_4wk"), F.col("outliers")).alias("health_status"),
                    "top_store", "top_store_sales", "bottom_store", "bottom_store_sales", "store_count")


@register("regional_table", with_fact("""
SELECT region, CAST(sum(weekly_sales) AS DOUBLE) AS revenue,
       round(round(coalesce(any_value(rt.trend), 0.0), 6) * 100, 6) AS trend_pct,
       CAST(sum(transactions) AS DOUBLE) AS transactions,
       round(CASE WHEN sum(transactions) > 0 THEN CAST(sum(weekly_sales) AS DOUBLE) / CAST(sum(transactions) AS DOUBLE)
                  ELSE 0.0 END, 6) AS avg_per_txn
FROM fact JOIN rt USING (region) GROUP BY region""", tail_cte("region", "rt")))
def q_regional_table(spark, sf):
    r = E.region_metrics(fact_view(spark, sf), ties=TIES)
    return r.select("region", F.col("sales").alias("revenue"), r6(F.col("trend_4wk") * 100).alias("trend_pct"),
                    "transactions", F.col("avg_transaction_value").alias("avg_per_txn")).orderBy(F.col("revenue").desc())


@register("health_bands_store", with_fact("""
SELECT store, round(trend, 6) AS trend,
       CASE WHEN trend IS NULL THEN NULL WHEN trend >= 0.10 THEN 'excellent' WHEN trend >= 0.03 THEN 'good'
            WHEN trend >= -0.03 THEN 'watch' WHEN trend >= -0.10 THEN 'at_risk' ELSE 'critical' END AS health_band,
       CASE WHEN trend IS NULL THEN NULL WHEN trend >= 0.05 THEN 'strong' WHEN trend >= 0.0 THEN 'stable'
            WHEN trend >= -0.05 THEN 'soft' ELSE 'declining' END AS growth_class
FROM tr""", tail_cte("store", "tr")))
def q_health_bands(spark, sf):
    r = fact_rules()
    t = E.row_tail_trend(fact_view(spark, sf), "store", ties=TIES, out="trend")
    return t.select("store", r6("trend").alias("trend"), FD.health_band(F.col("trend"), r).alias("health_band"),
                    FD.growth_class(F.col("trend"), r).alias("growth_class"))


@register("store_floors", with_fact("""
SELECT store, CAST(count(*) AS BIGINT) AS weeks,
       CAST(count(*) FILTER (WHERE s < 5000) AS BIGINT) AS weeks_below_sales_floor,
       CAST(count(*) FILTER (WHERE t < 50) AS BIGINT) AS weeks_below_txn_floor
FROM (SELECT store, CAST(date_trunc('week', date) AS DATE) + 6 AS week, sum(weekly_sales) AS s, sum(transactions) AS t
      FROM fact WHERE store IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2) GROUP BY store"""))
def q_store_floors(spark, sf):
    return FD.store_floors(fact_view(spark, sf), fact_rules())


@register("min_transactions_check", with_fact("""
SELECT CAST(count(*) FILTER (WHERE weekly_sales > 0 AND transactions < 1) AS BIGINT) AS rows_below_min_transactions,
       CAST(count(*) AS BIGINT) AS rows FROM clean""", DIRTY_CTE, TYPED_CTE, CLEAN_CTE))
def q_min_txn(spark, sf):
    cleaned = C.clean(dirty_fact(spark, sf), fact_rules())
    return FD.min_transactions_check(cleaned, fact_rules())


def _alert_metrics(spark, sf):
    f = fact_view(spark, sf)
    wow = wk.weekly_trend(f, rounded=False).select(F.col("wow_last").alias("wow_pct"))
    dec = T.store_4wk_aligned(f).agg(F.count_if(F.col("change") < 0).cast("long").alias("store_4wk_decline"))
    comp = Q.completeness(C.coerce_types(dirty_fact(spark, sf), fact_rules()))
    miss = comp.select((F.col("missing_count") / (F.col("rows") * F.col("cols"))).alias("missing_pct"))
    return one_row(wow, dec, miss)


@register("alerts", with_fact("""
SELECT name, severity, fired, message FROM (
  SELECT 'Revenue Drop Alert' AS name, 'high' AS severity, coalesce(wow_pct < -0.15, false) AS fired,
         'Sales changed by ' || printf('%.1f%%', wow_pct * 100) || ' from one week to the next' AS message FROM mt
  UNION ALL
  SELECT 'Store Performance Alert', 'medium', coalesce(store_4wk_decline > 3, false),
         CAST(store_4wk_decline AS VARCHAR) || ' stores sold less than in the four weeks before' FROM mt
  UNION ALL
  SELECT 'Data Quality Alert', 'high', coalesce(missing_pct > 0.10, false),
         printf('%.1f%%', missing_pct * 100) || ' of the cells are missing' FROM mt)
WHERE fired""", WEEKLY_CTE, DIRTY_CTE, TYPED_CTE, week_cte("store", "sw"), "al AS (" + ALIGNED_SQL + ")",
    f"""mt AS (SELECT (SELECT max(CASE WHEN k = 1 THEN wow END) FROM growth) AS wow_pct,
       (SELECT CAST(count(*) FILTER (WHERE change < 0) AS BIGINT) FROM al) AS store_4wk_decline,
       (SELECT (count(*) FILTER (WHERE date IS NULL) + count(*) FILTER (WHERE store IS NULL)
               + count(*) FILTER (WHERE department IS NULL) + count(*) FILTER (WHERE region IS NULL)
               + count(*) FILTER (WHERE weekly_sales IS NULL) + count(*) FILTER (WHERE transactions IS NULL)
               + count(*) FILTER (WHERE l_orderkey IS NULL) + count(*) FILTER (WHERE l_linenumber IS NULL))
               / (count(*) * 8) FROM typed) AS missing_pct)"""))
def q_alerts(spark, sf):
    return FD.alerts(_alert_metrics(spark, sf), fact_rules())


FINDINGS_SQL = """
SELECT 'momentum' AS section, CAST(NULL AS VARCHAR) AS entity, 'change_pct' AS metric, round(change_pct, 6) AS value,
       CASE WHEN change_pct > 10 THEN 'revenue_jump' WHEN change_pct < -10 THEN 'revenue_drop' ELSE 'revenue_stable' END AS rule,
       printf('Revenue moved %+.1f%% vs the previous week', change_pct) AS message FROM mo WHERE prev <> 0
UNION ALL
SELECT 'last_week', NULL, 'last_wow_pct', round(last_wow_pct, 6),
       CASE WHEN last_wow_pct > 3 THEN 'scale_winners' WHEN last_wow_pct < -3 THEN 'diagnose_blockers' ELSE 'steady_state' END,
       CASE WHEN last_wow_pct > 3 THEN 'Last week grew' WHEN last_wow_pct < -3 THEN 'Last week shrank' ELSE 'Last week was steady' END FROM ws
UNION ALL
SELECT 'drivers', NULL, 'current_sales', round(cur, 6), 'current_sales', 'Sales of the last week' FROM mo WHERE cur <> 0
UNION ALL
SELECT 'driver_actions', bottom_region, 'follow_up', 1.0, 'improve', 'Targeted improvement' FROM rtb
UNION ALL
SELECT 'driver_actions', top, 'follow_up', 2.0, 'expand', 'Expand what works' FROM db
UNION ALL
SELECT 'driver_actions', top_region, 'follow_up', 3.0, 'replicate', 'Document and share practices' FROM rtb
UNION ALL
SELECT 'growth_pulse', NULL, 'last_wow_pct', round(last_wow_pct, 6),
       CASE WHEN last_wow_pct > 10 THEN 'strong_momentum' WHEN last_wow_pct < -10 THEN 'sharp_decline' ELSE 'flat' END,
       printf('Last week %+.1f%% week over week', last_wow_pct) FROM ws
UNION ALL
SELECT 'momentum', NULL, 'trend_4wk_pct', round(trend_4wk_pct, 6),
       CASE WHEN abs(trend_4wk_pct) > 5 THEN CASE WHEN trend_4wk_pct > 0 THEN 'accelerating' ELSE 'slowing' END
            ELSE 'flat_trend' END,
       printf('4-week trend %+.1f%%', trend_4wk_pct) FROM mt
UNION ALL
SELECT 'store_pulse', NULL, 'stores_growing', round(CAST(stores_growing AS DOUBLE), 6),
       CASE WHEN stores_growing > stores_declining THEN 'majority_growing' ELSE 'majority_declining' END,
       printf('%d of %d stores growing', stores_growing, stores_growing + stores_declining) FROM pu
UNION ALL
SELECT 'store_pulse', best_store, 'best_growth_pct', round(best_growth_pct, 6), 'best_store_up',
       printf('%s up %.1f%% over 4 weeks', best_store, best_growth_pct) FROM pu WHERE best_growth_pct > 10
UNION ALL
SELECT 'store_pulse', worst_store, 'worst_decline_pct', round(worst_decline_pct, 6), 'worst_store_down',
       printf('%s down %.1f%% over 4 weeks', worst_store, worst_decline_pct) FROM pu WHERE worst_decline_pct < -10
UNION ALL
SELECT 'benchmarks', top, 'top_store_avg_sales', round(avg_sales, 6), 'leader_store',
       printf('%s leads the stores', top) FROM sb
UNION ALL
SELECT 'benchmarks', bottom, 'bottom_gap_pct', round(bottom_gap_pct, 6), 'lagging_store',
       printf('%s trails the store average by %.1f%%', bottom, bottom_gap_pct) FROM sb WHERE top <> bottom
UNION ALL
SELECT 'benchmarks', top, 'dept_avg_sales', round(avg_sales, 6), 'leader_department',
       printf('%s leads the departments', top) FROM db
UNION ALL
SELECT 'drivers', top_region, 'top_region_sales', round(top_region_sales, 6), 'region_gap',
       printf('%s outperforms %s', top_region, bottom_region) FROM rtb
UNION ALL
SELECT 'drivers', NULL, 'top_dept_share', round(top_dept_share, 6),
       CASE WHEN top_dept_share > 30 THEN 'over_concentrated' ELSE 'balanced_portfolio' END,
       printf('Top department holds %.1f%% of sales', top_dept_share) FROM dc
UNION ALL
SELECT 'actions', coalesce(worst_store, (SELECT bottom FROM sb)), 'follow_up', 1.0, 'recover', 'Recovery plan' FROM pu
UNION ALL
SELECT 'actions', coalesce(best_store, (SELECT top FROM sb)), 'follow_up', 2.0, 'replicate',
       'Document and share practices' FROM pu
UNION ALL
SELECT 'actions', top, 'follow_up', 3.0, 'promote', 'Increase promotional focus' FROM db"""


def _bench_ctx_sql(cat: str, name: str) -> str:
    return f"""{name}_s AS (SELECT {cat} AS cat, sum(weekly_sales) AS v FROM fact
                WHERE weekly_sales IS NOT NULL AND {cat} IS NOT NULL GROUP BY {cat}),
{name} AS (
  SELECT avg AS avg_sales, (SELECT cat FROM {name}_s ORDER BY v DESC, cat LIMIT 1) AS top,
         (SELECT cat FROM {name}_s ORDER BY v ASC, cat LIMIT 1) AS bottom,
         CASE WHEN avg <> 0 THEN (avg - (SELECT CAST(v AS DOUBLE) FROM {name}_s ORDER BY v ASC, cat LIMIT 1)) / avg * 100
              ELSE 0.0 END AS bottom_gap_pct
  FROM (SELECT CAST(sum(v) AS DOUBLE) / count(*) AS avg FROM {name}_s))"""


@register("findings", with_fact(FINDINGS_SQL, WEEKLY_CTE, week_cte("store", "sw"), "al AS (" + ALIGNED_SQL + ")",
    *DM_CTES,
    """mo AS (
  SELECT CASE WHEN prev > 0 THEN (cur - prev) / prev * 100 ELSE 0.0 END AS change_pct, cur, prev
  FROM (SELECT cur, CASE WHEN n > 1 THEN prev0 ELSE cur END AS prev
        FROM (SELECT count(*) AS n, max(CASE WHEN k = 1 THEN sd END) AS cur,
                     max(CASE WHEN k = 2 THEN sd END) AS prev0 FROM growth)))""",
    """ws AS (SELECT coalesce(max(CASE WHEN k = 1 THEN wow * 100 END), 0.0) AS last_wow_pct FROM growth)""",
    """mt AS (SELECT coalesce(CASE WHEN count(*) >= 4 AND max(CASE WHEN k = 4 THEN ma4 END) <> 0 THEN
   (max(CASE WHEN k = 1 THEN ma4 END) - max(CASE WHEN k = 4 THEN ma4 END))
   / max(CASE WHEN k = 4 THEN ma4 END) * 100 END, 0.0) AS trend_4wk_pct FROM growth)""",
    """pu AS (
  SELECT CAST(count(*) FILTER (WHERE change > 0) AS BIGINT) AS stores_growing,
         CAST(count(*) FILTER (WHERE change < 0) AS BIGINT) AS stores_declining,
         (SELECT store FROM al WHERE change IS NOT NULL ORDER BY change DESC, store LIMIT 1) AS best_store,
         (SELECT change * 100 FROM al WHERE change IS NOT NULL ORDER BY change DESC, store LIMIT 1) AS best_growth_pct,
         (SELECT store FROM al WHERE change IS NOT NULL ORDER BY change ASC, store LIMIT 1) AS worst_store,
         (SELECT change * 100 FROM al WHERE change IS NOT NULL ORDER BY change ASC, store LIMIT 1) AS worst_decline_pct
  FROM al)""",
    _bench_ctx_sql("store", "sb"), _bench_ctx_sql("department", "db"),
    "r AS (SELECT region, sum(weekly_sales) AS s FROM fact WHERE region IS NOT NULL GROUP BY region)",
    """rtb AS (
  SELECT (SELECT region FROM r ORDER BY s DESC, region LIMIT 1) AS top_region,
         (SELECT CAST(s AS DOUBLE) FROM r ORDER BY s DESC, region LIMIT 1) AS top_region_sales,
         (SELECT region FROM r ORDER BY s ASC, region LIMIT 1) AS bottom_region
  FROM (SELECT 1) t(x))""",
    """dc AS (SELECT CASE WHEN sum(sales) > 0 THEN max(sales) / sum(sales) * 100 ELSE 0.0 END AS top_dept_share FROM dm)"""))
def q_findings(spark, sf):
    """R2-R6 findings table over the one-row metric frames."""
    f = fact_view(spark, sf)
    dm = E.department_metrics(f, ties=TIES, rounded=False)
    rm = E.region_metrics(f, ties=TIES)
    tb = E.top_bottom(rm.select("region", "sales"), "region", "sales", "region").select(
        "top_region", F.col("top_region_value").alias("top_region_sales"), "bottom_region")
    return FD.findings(
        momentum=wk.momentum(f, rounded=False), wow=wk.wow_stats(f, rounded=False), pulse=T.store_pulse(T.store_4wk_aligned(f)),
        store_bench=B.benchmark_context(f, "store"), dept_bench=B.benchmark_context(f, "department"),
        dept_conc=B.department_concentration(dm), top_bottom=tb, ma_trend=wk.ma_trend_pct(f, rounded=False))


def _entity_findings_sql() -> str:
    """Metrics and bands of every kind of entity, in DuckDB SQL."""
    number = lambda x: "CAST('%sinf' AS DOUBLE)" % ("-" if x < 0 else "") if abs(x) == EFD.INF else f"CAST({x} AS DOUBLE)"
    rules = ", ".join(f"('{b.metric}', {number(b.low)}, {b.at_low}, {number(b.high)}, {b.at_high}, '{b.section}', '{b.rule}', '{b.text}')" for b in EFD.BANDS)
    kinds = []
    for e in ("store", "region", "department"):
        part = lambda a, b: f"sum(sales) FILTER (WHERE date > lw - {a} AND date <= lw - {b})"  # noqa: E731, B023
        change = lambda now, before: f"CASE WHEN {before} > 0 THEN (CAST({now} AS DOUBLE) - CAST({before} AS DOUBLE)) / CAST({before} AS DOUBLE) * 100 END"
        kinds.append(f"""SELECT '{e}' AS kind, {e} AS entity, CAST(cur AS DOUBLE) AS current_sales, {change('cur', 'prev')} AS wow_pct, {change('l4', 'p4')} AS trend_4wk_pct,
  (CAST(whole AS DOUBLE) - mean) / mean * 100 AS gap_pct, CAST(whole AS DOUBLE) / total * 100 AS share_pct
FROM (SELECT {e}, sum(sales) AS whole, {part(7, 0)} AS cur, {part(14, 7)} AS prev, {part(28, 0)} AS l4, {part(56, 28)} AS p4
      FROM ew_{e}, (SELECT max(date) AS lw FROM ew_{e}) GROUP BY {e}),
     (SELECT CAST(sum(sales) AS DOUBLE) / count(DISTINCT {e}) AS mean, CAST(sum(sales) AS DOUBLE) AS total FROM ew_{e})""")
    return with_fact("""
SELECT kind, entity, u.metric, round(value, 6) AS value, section, rule, entity || ': ' || text AS message
FROM (UNPIVOT em ON current_sales, wow_pct, trend_4wk_pct, gap_pct, share_pct INTO NAME metric VALUE value) u
JOIN rules r ON u.metric = r.metric AND (value > low OR (at_low AND value = low)) AND (value < high OR (at_high AND value = high))""",
        *[week_cte(e, f"ew_{e}") for e in ("store", "region", "department")], "em AS (" + "\nUNION ALL ".join(kinds) + ")",
        f"rules AS (SELECT * FROM (VALUES {rules}) t(metric, low, at_low, high, at_high, section, rule, text))")


@register("entity_findings", _entity_findings_sql())
def q_entity_findings(spark, sf):
    """R2-R6 for each store, region and department."""
    f = EFD.entity_findings(fact_view(spark, sf))
    return f.select("kind", "entity", "metric", r6("value").alias("value"), "section", "rule", "message")
