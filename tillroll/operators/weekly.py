"""Overall period series and the measures computed on it (A1, A15, A16, A25,
A27, D5, D6, W4-W6, W8).

The series has one row per calendar period (dense, G2), so its size is fixed
by the time span.  Windows over it without a partition run on at most a few
thousand rows.  Every row-level step before that is a partial aggregate.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import period_label
from ..functions.safe import money, pct_change, r6, safe_div


def period_sums(df: DataFrame, date: str = "date", sales: str = "weekly_sales",
                txns: str | None = "transactions", freq: str = "W",
                extra_aggs: dict | None = None) -> DataFrame:
    """Sparse sums per period label (only observed periods)."""
    label = period_label(date, freq).alias("date")
    aggs = [F.sum(sales).alias("weekly_sales_sum")]
    if txns:
        aggs.append(F.sum(txns).alias("transactions_sum"))
    for name, expr in (extra_aggs or {}).items():
        aggs.append(expr.alias(name))
    return df.where(F.col(date).isNotNull()).groupBy(label).agg(*aggs)


def weekly_dense(df: DataFrame, date: str = "date", sales: str = "weekly_sales",
                 txns: str | None = "transactions", freq: str = "W",
                 extra_aggs: dict | None = None) -> DataFrame:
    """Dense period sums (A1/A16): every period between the first and last
    observed one; empty periods sum to 0 (G2, G5).

    The gaps are filled from the sparse series itself: each observed period
    explodes into itself plus the empty periods before the next observed one
    (``lead`` over the period series, one row per period).  There is no
    calendar self-join, so the fact is scanned once.
    """
    sums = period_sums(df, date, sales, txns, freq, extra_aggs)
    nxt = F.lead("date").over(Window.orderBy("date"))
    filled = sums.withColumn("_span", gap_periods(F.col("date"), nxt, freq)).select(
        "*", F.explode("_span").alias("_d"))
    observed = F.col("_d") == F.col("date")
    cols = [F.col("_d").alias("date"),
            F.when(observed, F.col("weekly_sales_sum")).otherwise(F.lit(0)).alias("weekly_sales_sum")]
    if txns:
        cols.append(F.when(observed, F.col("transactions_sum")).otherwise(F.lit(0)).alias("transactions_sum"))
    cols += [F.when(observed, F.col(n)).alias(n) for n in (extra_aggs or {})]
    return filled.select(*cols)


def gap_periods(cur, nxt, freq: str = "W"):
    """Array of period labels from ``cur`` up to (not including) ``nxt``;
    just ``cur`` when there is no next period."""
    if freq == "D":
        end = F.coalesce(F.date_sub(nxt, 1), cur)
        return F.sequence(cur, end, F.expr("INTERVAL 1 DAY"))
    if freq == "W":
        end = F.coalesce(F.date_sub(nxt, 7), cur)
        return F.sequence(cur, end, F.expr("INTERVAL 7 DAYS"))
    if freq == "M":
        start = F.trunc(cur, "MM")
        end = F.coalesce(F.trunc(F.add_months(nxt, -1), "MM"), start)
        return F.transform(F.sequence(start, end, F.expr("INTERVAL 1 MONTH")), lambda m: F.last_day(m))
    raise ValueError(f"unsupported time_freq {freq!r}")


def with_growth(weekly: DataFrame) -> DataFrame:
    """W4 + W5: week-over-week growth (fraction) and 4-period moving average."""
    w = Window.orderBy("date")
    s = F.col("weekly_sales_sum").cast("double")
    n_weeks = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return (weekly
            .withColumn("wow_growth_pct",
                        F.when(n_weeks > 1, pct_change(s, F.lag(s).over(w))))
            .withColumn("ma_4wk", F.avg(s).over(w.rowsBetween(-3, 0))))


def weekly_kpis(df: DataFrame, freq: str = "W", **cols) -> DataFrame:
    """The KPI series: date, sums, wow_growth_pct, ma_4wk (report types)."""
    g = with_growth(weekly_dense(df, freq=freq, **cols))
    return g.select(
        "date", money("weekly_sales_sum").alias("weekly_sales_sum"),
        F.col("transactions_sum").cast("double").alias("transactions_sum"),
        r6("wow_growth_pct").alias("wow_growth_pct"), r6("ma_4wk").alias("ma_4wk"))


def _tail_indexed(weekly: DataFrame) -> DataFrame:
    """Weekly rows with k = 1 for the last period, 2 for the one before..."""
    return weekly.withColumn("_k", F.row_number().over(Window.orderBy(F.col("date").desc())))


def weekly_trend(df: DataFrame, freq: str = "W", rounded: bool = True, **cols) -> DataFrame:
    """W6 and the last WoW: one row with trend_4wk, wow_last and weeks.

    trend_4wk = mean(last 4) / mean(previous 4) - 1 on dense periods;
    NULL with fewer than 8 periods or a previous mean <= 0.  Thresholds are
    for unrounded values (``rounded=False``).
    """
    r = _r(rounded)
    g = _tail_indexed(with_growth(weekly_dense(df, freq=freq, **cols)))
    s = F.col("weekly_sales_sum").cast("double")
    agg = g.agg(
        F.count(F.lit(1)).alias("weeks"),
        F.avg(F.when(F.col("_k") <= 4, s)).alias("_l4"),
        F.avg(F.when(F.col("_k").between(5, 8), s)).alias("_p4"),
        F.max(F.when(F.col("_k") == 1, F.col("wow_growth_pct"))).alias("wow_last"))
    trend = F.when((F.col("weeks") >= 8) & (F.col("_p4") > 0),
                   (F.col("_l4") - F.col("_p4")) / F.col("_p4"))
    return agg.select(r(trend).alias("trend_4wk"), r("wow_last").alias("wow_last"),
                      F.col("weeks").cast("long").alias("weeks"))


def last_periods_totals(df: DataFrame, n: int = 4, freq: str = "W", **cols) -> DataFrame:
    """Sums of the last n dense periods and the per-period averages."""
    g = _tail_indexed(weekly_dense(df, freq=freq, **cols))
    last = g.where(F.col("_k") <= n)
    a = last.agg(F.sum("weekly_sales_sum").alias("s"), F.sum("transactions_sum").alias("t"))
    return a.select(
        money(F.coalesce("s", F.lit(0))).alias("last4_sales"),
        F.coalesce("t", F.lit(0)).cast("long").alias("last4_transactions"),
        r6(F.coalesce("s", F.lit(0)).cast("double") / n).alias("avg_sales_per_week"),
        r6(F.coalesce("t", F.lit(0)).cast("double") / n).alias("avg_transactions_per_week"),
        r6(safe_div(F.coalesce("s", F.lit(0)), "t")).alias("avg_transaction_value"))


def _r(rounded: bool):
    return r6 if rounded else (lambda c: F.col(c) if isinstance(c, str) else c)


def ma_trend_pct(df: DataFrame, freq: str = "W", rounded: bool = True, **cols) -> DataFrame:
    """(ma4[last] - ma4[last-3]) / ma4[last-3] * 100; 0 when < 4 periods or 0.
    Rules compare unrounded values: pass ``rounded=False`` for them."""
    g = _tail_indexed(with_growth(weekly_dense(df, freq=freq, **cols)))
    a = g.agg(F.count(F.lit(1)).alias("n"),
              F.max(F.when(F.col("_k") == 1, F.col("ma_4wk"))).alias("m1"),
              F.max(F.when(F.col("_k") == 4, F.col("ma_4wk"))).alias("m4"))
    v = F.when((F.col("n") >= 4) & (F.col("m4") != 0), (F.col("m1") - F.col("m4")) / F.col("m4") * 100)
    return a.select(_r(rounded)(F.coalesce(v, F.lit(0.0))).alias("trend_4wk_pct"))


def wow_stats(df: DataFrame, freq: str = "W", rounded: bool = True, **cols) -> DataFrame:
    """Last and mean WoW in %, count of rising and falling periods."""
    g = _tail_indexed(with_growth(weekly_dense(df, freq=freq, **cols)))
    s = F.col("weekly_sales_sum").cast("double")
    prev = F.lag(s).over(Window.orderBy("date"))
    g = g.withColumn("_prev", prev)
    a = g.agg(
        F.max(F.when(F.col("_k") == 1, F.col("wow_growth_pct") * 100)).alias("last_wow_pct"),
        F.avg(F.col("wow_growth_pct") * 100).alias("avg_wow_pct"),
        F.count_if(s > F.col("_prev")).alias("pos_weeks"),
        F.count_if(s < F.col("_prev")).alias("neg_weeks"))
    r = _r(rounded)
    return a.select(r(F.coalesce("last_wow_pct", F.lit(0.0))).alias("last_wow_pct"),
                    r(F.coalesce("avg_wow_pct", F.lit(0.0))).alias("avg_wow_pct"),
                    F.col("pos_weeks").cast("long"), F.col("neg_weeks").cast("long"))


def momentum(df: DataFrame, freq: str = "W", rounded: bool = True, **cols) -> DataFrame:
    """Current vs previous period, 4-period mean, volatility and velocity."""
    g = _tail_indexed(weekly_dense(df, freq=freq, **cols))
    s = F.col("weekly_sales_sum").cast("double")
    a = g.agg(F.count(F.lit(1)).alias("n"),
              F.max(F.when(F.col("_k") == 1, s)).alias("cur"),
              F.max(F.when(F.col("_k") == 2, s)).alias("prev"),
              F.max(F.when(F.col("_k") == 5, s)).alias("p5"),
              F.avg(F.when(F.col("_k") <= 4, s)).alias("avg4"),
              F.stddev_samp(s).alias("std"))
    prev = F.when(F.col("n") > 1, F.col("prev")).otherwise(F.col("cur"))
    four = F.when(F.col("n") > 4, F.col("p5")).otherwise(F.col("cur"))
    recent = F.col("cur") - prev
    hist = F.when(F.col("n") > 4, prev - four).otherwise(F.lit(0.0))
    chg_pct = F.when(prev > 0, (F.col("cur") - prev) / prev * 100).otherwise(F.lit(0.0))
    r = _r(rounded)
    return a.select(
        r("cur").alias("current_value"), r(prev).alias("previous_value"),
        r(recent).alias("change_amount"), r(chg_pct).alias("change_pct"),
        r("avg4").alias("four_week_avg"),
        F.when(F.col("cur") > F.col("avg4"), "above").otherwise("below").alias("vs_four_week_avg"),
        r("std").alias("volatility"),
        F.when(F.abs(recent) > F.abs(hist), "accelerating").otherwise("slowing").alias("velocity"),
        F.col("n").cast("long").alias("data_points"))


def weekly_stats(df: DataFrame, rules: dict | None = None, freq: str = "W",
                 date: str = "date", sales: str = "weekly_sales", txns: str = "transactions") -> DataFrame:
    """D5 + D6: weekly sum/mean/std of sales, sum/mean of transactions and the
    derived expressions declared in the rules, evaluated as Spark SQL."""
    extra = {
        # exact sum / count: the same double in every engine
        "weekly_sales_mean": F.sum(sales).cast("double") / F.count(sales),
        "weekly_sales_std": F.stddev_samp(F.col(sales).cast("double")),
        "transactions_mean": F.sum(txns).cast("double") / F.count(txns),
    }
    w = weekly_dense(df, date=date, sales=sales, txns=txns, freq=freq, extra_aggs=extra)
    w = w.select("date", money("weekly_sales_sum").alias("weekly_sales_sum"),
                 F.col("transactions_sum").cast("double").alias("transactions_sum"),
                 "weekly_sales_mean", "weekly_sales_std", "transactions_mean")
    derived = ((rules or {}).get("kpis", {}) or {}).get("derived", {}) or {}
    for name, expr in derived.items():
        w = w.withColumn(name, F.expr(expr))
    return w.select("date", "weekly_sales_sum", "transactions_sum",
                    *[r6(c).alias(c) for c in w.columns
                      if c not in ("date", "weekly_sales_sum", "transactions_sum")])


#: What a rules file may ask of a column's values in a period; each is a partial aggregate.
AGGREGATES = {
    "sum": lambda c: F.sum(c).cast("double"),
    "count": lambda c: F.count(c),
    "mean": lambda c: F.sum(c).cast("double") / F.count(c),
    "std": lambda c: F.stddev_samp(F.col(c).cast("double")),
    "min": lambda c: F.min(c).cast("double"),
    "max": lambda c: F.max(c).cast("double"),
}


def rule_aggregates(df: DataFrame, rules: dict, freq: str | None = None, date: str = "date", sales: str = "weekly_sales") -> DataFrame:
    """The aggregates that the rules' ``kpis.aggregates`` list, by period: columns ``<column>_<function>``.

    Optional columns (``dataset.optional_columns``) that the data has and the
    rules say nothing of are summed if they are numbers.  Columns that the
    data lacks are left out.  Periods without rows have sums and counts of 0
    and nulls otherwise; then the rules' derived expressions follow, as far as
    their columns are there.
    """
    kpis, dataset = ((rules.get(k) or {}) for k in ("kpis", "dataset"))
    wanted = {c: list(fs) for c, fs in (kpis.get("aggregates") or {}).items() if c in df.columns}
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    for c in dataset.get("optional_columns") or []:
        if c in numbers:
            wanted.setdefault(c, ["sum"])
    unknown = sorted({f for fs in wanted.values() for f in fs} - set(AGGREGATES))
    if unknown:
        raise ValueError(f"unknown aggregates {unknown}; use {sorted(AGGREGATES)}")
    named = {f"{c}_{f}": AGGREGATES[f](c) for c, fs in wanted.items() for f in fs}
    inner = {f"_{n}": e for n, e in named.items()}
    w = weekly_dense(df, date, sales, None, freq or kpis.get("time_freq") or "W", inner)
    zero = lambda n: F.coalesce(F.col(f"_{n}"), F.lit(0)) if n.endswith(("_sum", "_count")) else F.col(f"_{n}")
    w = w.select("date", *[zero(n).alias(n) for n in named])
    for name, expr in (kpis.get("derived") or {}).items():
        used = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", expr))
        if {x for x in used if x.endswith(tuple(f"_{f}" for f in AGGREGATES))} <= set(w.columns):
            w = w.withColumn(name, F.expr(expr))
    return w


def wow_sign_class(weekly: DataFrame, up: str = "up", down: str = "down") -> DataFrame:
    """Sign class of the week-over-week growth; a missing growth counts as >= 0."""
    return weekly.withColumn("wow_class", F.when(F.coalesce(F.col("wow_growth_pct"), F.lit(0.0)) >= 0, up)
                             .otherwise(down))


def dense_series(df: DataFrame, value: str, date: str = "date", freq: str = "W") -> DataFrame:
    """Dense period sums of any one column (empty periods 0)."""
    w = weekly_dense(df, date=date, sales=value, txns=None, freq=freq)
    return w.select("date", F.col("weekly_sales_sum").alias(f"{value}_sum"))
