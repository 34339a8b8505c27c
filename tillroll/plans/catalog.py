"""Registered queries: each Spark query over the fact view and its DuckDB twin.

Every query reads the whole driver tables through ``fact_view`` (or the
whole ``events`` table); nothing is sampled or capped except where a limit
is the feature (top-n, first-20 sample).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The fact view in DuckDB SQL (same joins and casts as sources.tables.fact_view).
FACT_CTE = """fact AS (
  SELECT CAST(l.l_shipdate AS DATE) AS date, s.s_name AS store, p.p_brand AS department,
         r.r_name AS region,
         CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS weekly_sales,
         CAST(l.l_quantity AS BIGINT) AS transactions, l.l_orderkey, l.l_linenumber
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

# Dense weekly sums in DuckDB SQL (week ends Sunday).
WEEKLY_CTE = """wk AS (
  SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS date,
         sum(weekly_sales) AS s, sum(transactions) AS t
  FROM fact WHERE date IS NOT NULL GROUP BY 1),
cal AS (
  SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP),
                                     INTERVAL 7 DAY)) AS DATE) AS date FROM wk),
dense AS (
  SELECT c.date, coalesce(w.s, 0) AS s, coalesce(w.t, 0) AS t,
         CAST(coalesce(w.s, 0) AS DOUBLE) AS sd
  FROM cal c LEFT JOIN wk w ON c.date = w.date),
growth AS (
  SELECT date, s, t, sd,
         CASE WHEN count(*) OVER () > 1 THEN
           (sd - lag(sd) OVER (ORDER BY date)) / nullif(lag(sd) OVER (ORDER BY date), 0) END AS wow,
         avg(sd) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ma4,
         row_number() OVER (ORDER BY date DESC) AS k
  FROM dense)"""


def with_fact(sql: str, *ctes: str) -> str:
    parts = [FACT_CTE, *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Importing the query modules fills the registry.
from . import queries_clean, queries_core, queries_entities, queries_more, queries_pipeline  # noqa: E402,F401
