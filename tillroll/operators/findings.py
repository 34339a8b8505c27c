"""Rule-based classification, findings and alerts.

Rules are ``when`` chains over metric DataFrames, so they classify every
store or region at once.  The findings table has the shape
(section, entity, metric, value, rule, message): one row per rule that
applies, exploded from one array of rule structs over the combined metrics
row, so each metric frame is evaluated once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import week_end
from ..functions.scalar import one_row


def health_status(trend: Column, outliers: Column) -> Column:
    """NULL trend -> Inconclusive; >= 5% with <= 5 outliers -> Healthy;
    >= 0 -> Watch; else Declining."""
    return (F.when(trend.isNull(), "Inconclusive")
            .when((trend >= 0.05) & (outliers <= 5), "Healthy")
            .when(trend >= 0.0, "Watch")
            .otherwise("Declining"))


def health_band(trend: Column, rules: dict) -> Column:
    """Band from the rules' health thresholds (excellent ... critical)."""
    h = (((rules.get("kpis", {}) or {}).get("thresholds", {}) or {}).get("health") or {})
    order = sorted(((k, float(v)) for k, v in h.items()), key=lambda kv: -kv[1])
    expr = None
    for name, lo in order:
        cond = trend >= F.lit(lo)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    if expr is None:
        return F.lit(None).cast("string")
    return F.when(trend.isNull(), F.lit(None)).otherwise(expr.otherwise(order[-1][0]))


def growth_class(growth: Column, rules: dict) -> Column:
    """Growth class from thresholds.growth (strong / stable / soft / declining)."""
    g = (((rules.get("kpis", {}) or {}).get("thresholds", {}) or {}).get("growth") or {})
    strong, stable, declining = float(g.get("strong", 0.05)), float(g.get("stable", 0.0)), float(g.get("declining", -0.05))
    return (F.when(growth.isNull(), F.lit(None))
            .when(growth >= strong, "strong").when(growth >= stable, "stable")
            .when(growth >= declining, "soft").otherwise("declining"))


def store_floors(df: DataFrame, rules: dict, store: str = "store", date: str = "date",
                 sales: str = "weekly_sales", txns: str = "transactions") -> DataFrame:
    """Per store, weeks below the sales and the transaction floor."""
    s = (((rules.get("kpis", {}) or {}).get("thresholds", {}) or {}).get("stores") or {})
    min_s, min_t = float(s.get("min_sales_per_week", 5000)), float(s.get("min_transactions_per_week", 50))
    w = (df.where(F.col(store).isNotNull() & F.col(date).isNotNull())
         .groupBy(store, week_end(date).alias("week"))
         .agg(F.sum(sales).alias("s"), F.sum(txns).alias("t")))
    return w.groupBy(store).agg(
        F.count(F.lit(1)).cast("long").alias("weeks"),
        F.count_if(F.col("s") < min_s).cast("long").alias("weeks_below_sales_floor"),
        F.count_if(F.col("t") < min_t).cast("long").alias("weeks_below_txn_floor"))


def min_transactions_check(df: DataFrame, rules: dict, sales: str = "weekly_sales",
                           txns: str = "transactions") -> DataFrame:
    """D3: rows with sales but fewer transactions than the rule's minimum."""
    v = ((rules.get("cleaning", {}) or {}).get("validation") or {})
    m = float(v.get("min_transactions_per_sale", 1))
    return df.agg(F.count_if((F.col(sales) > 0) & (F.col(txns) < m)).cast("long").alias("rows_below_min_transactions"),
                  F.count(F.lit(1)).cast("long").alias("rows"))


_FMT = re.compile(r"\{(\w+)(?::([^}]*))?\}")


def render_message(template: str) -> Column:
    """Turn a rules-file message template into a Spark string expression.

    Supports ``{name}``, ``{name:.Nf}`` and ``{name:.N%}`` placeholders.
    """
    parts: list[Column] = []
    pos = 0
    for m in _FMT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        name, spec = m.group(1), m.group(2) or ""
        c = F.col(name)
        if spec.endswith("%"):
            places = int(spec[1:-1] or 0) if spec.startswith(".") else 0
            parts.append(F.format_string(f"%.{places}f%%", c.cast("double") * 100))
        elif spec.endswith("f"):
            places = int(spec[1:-1] or 0) if spec.startswith(".") else 6
            parts.append(F.format_string(f"%.{places}f", c.cast("double")))
        else:
            parts.append(c.cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def alerts(metrics: DataFrame, rules: dict) -> DataFrame:
    """Evaluate each alert rule's SQL condition on the one-row metrics
    frame; one output row per rule that fires.  The metrics are evaluated
    once: every rule is one struct of an array that is exploded."""
    a = rules.get("alerts", {}) or {}
    if not a.get("enabled", True) or not a.get("rules"):
        return metrics.sparkSession.createDataFrame([], "name string, severity string, fired boolean, message string")
    per_rule = [F.struct(F.lit(r["name"]).alias("name"), F.lit(r.get("severity", "medium")).alias("severity"),
                         F.coalesce(F.expr(r["condition"]), F.lit(False)).alias("fired"),
                         render_message(r.get("message", r["name"])).alias("message"))
                for r in a["rules"]]
    return metrics.select(F.explode(F.array(*per_rule)).alias("a")).select("a.*").where("fired")


def _row(section: str, entity: Column, metric: str, value: Column, rule: Column, message: Column,
         keep: Column | None = None) -> Column:
    return F.struct(F.lit(section).alias("section"), entity.cast("string").alias("entity"),
                    F.lit(metric).alias("metric"), F.round(value.cast("double"), 6).alias("value"),
                    rule.alias("rule"), message.alias("message"),
                    (keep if keep is not None else F.lit(True)).alias("_keep"))


def findings(momentum: DataFrame, wow: DataFrame, pulse: DataFrame, store_bench: DataFrame,
             dept_bench: DataFrame, dept_conc: DataFrame, top_bottom: DataFrame,
             ma_trend: DataFrame) -> DataFrame:
    """R2-R6 over the one-row metric frames; rows only for rules that apply.

    The metric frames are combined into one row (each evaluated once), then
    every rule is one struct of an array that is exploded and filtered.
    """
    sb = store_bench.select(*[F.col(c).alias(f"sb_{c}") for c in ("avg_sales", "top", "bottom", "bottom_gap_pct")])
    db = dept_bench.select(F.col("avg_sales").alias("db_avg_sales"), F.col("top").alias("db_top"))
    m = one_row(momentum.select("change_pct", "current_value", "previous_value"), wow.select("last_wow_pct"), ma_trend.select("trend_4wk_pct"),
                pulse.select("stores_growing", "stores_declining", "best_store", "best_growth_pct",
                             "worst_store", "worst_decline_pct"),
                sb, db, dept_conc.select("top_dept_share"),
                top_bottom.select("top_region", "top_region_sales", "bottom_region"))
    cp, lw, t = F.col("change_pct"), F.col("last_wow_pct"), F.col("trend_4wk_pct")
    g, d, sh = F.col("stores_growing"), F.col("stores_declining"), F.col("top_dept_share")
    rows = [
        # R2 revenue move
        _row("momentum", F.lit(None), "change_pct", cp,
             F.when(cp > 10, "revenue_jump").when(cp < -10, "revenue_drop").otherwise("revenue_stable"),
             F.format_string("Revenue moved %+.1f%% vs the previous week", cp),
             F.coalesce(F.col("previous_value") != 0, F.lit(False))),
        # R3 WoW band
        _row("growth_pulse", F.lit(None), "last_wow_pct", lw,
             F.when(lw > 10, "strong_momentum").when(lw < -10, "sharp_decline").otherwise("flat"),
             F.format_string("Last week %+.1f%% week over week", lw)),
        # R5 last week against 3 %
        _row("last_week", F.lit(None), "last_wow_pct", lw,
             F.when(lw > 3, "scale_winners").when(lw < -3, "diagnose_blockers").otherwise("steady_state"),
             F.when(lw > 3, "Last week grew").when(lw < -3, "Last week shrank").otherwise("Last week was steady")),
        # R5 4-week MA trend
        _row("momentum", F.lit(None), "trend_4wk_pct", t,
             F.when(F.abs(t) > 5, F.when(t > 0, "accelerating").otherwise("slowing")).otherwise("flat_trend"),
             F.format_string("4-week trend %+.1f%%", t)),
        # R5 store pulse
        _row("store_pulse", F.lit(None), "stores_growing", g,
             F.when(g > d, "majority_growing").otherwise("majority_declining"),
             F.format_string("%d of %d stores growing", g, g + d)),
        _row("store_pulse", F.col("best_store"), "best_growth_pct", F.col("best_growth_pct"), F.lit("best_store_up"),
             F.format_string("%s up %.1f%% over 4 weeks", F.col("best_store"), F.col("best_growth_pct")),
             F.coalesce(F.col("best_growth_pct") > 10, F.lit(False))),
        _row("store_pulse", F.col("worst_store"), "worst_decline_pct", F.col("worst_decline_pct"),
             F.lit("worst_store_down"),
             F.format_string("%s down %.1f%% over 4 weeks", F.col("worst_store"), F.col("worst_decline_pct")),
             F.coalesce(F.col("worst_decline_pct") < -10, F.lit(False))),
        # R4 / R5 benchmarks
        _row("benchmarks", F.col("sb_top"), "top_store_avg_sales", F.col("sb_avg_sales"), F.lit("leader_store"),
             F.format_string("%s leads the stores", F.col("sb_top"))),
        _row("benchmarks", F.col("sb_bottom"), "bottom_gap_pct", F.col("sb_bottom_gap_pct"), F.lit("lagging_store"),
             F.format_string("%s trails the store average by %.1f%%", F.col("sb_bottom"), F.col("sb_bottom_gap_pct")),
             F.coalesce(F.col("sb_top") != F.col("sb_bottom"), F.lit(False))),
        _row("benchmarks", F.col("db_top"), "dept_avg_sales", F.col("db_avg_sales"), F.lit("leader_department"),
             F.format_string("%s leads the departments", F.col("db_top"))),
        # R4 / R6 regions and department concentration
        _row("drivers", F.col("top_region"), "top_region_sales", F.col("top_region_sales"), F.lit("region_gap"),
             F.format_string("%s outperforms %s", F.col("top_region"), F.col("bottom_region"))),
        # R6 current sales and the drivers' follow-up entities
        _row("drivers", F.lit(None), "current_sales", F.col("current_value"), F.lit("current_sales"), F.lit("Sales of the last week"),
             F.coalesce(F.col("current_value") != 0, F.lit(False))),
        _row("driver_actions", F.col("bottom_region"), "follow_up", F.lit(1), F.lit("improve"), F.lit("Targeted improvement")),
        _row("driver_actions", F.col("db_top"), "follow_up", F.lit(2), F.lit("expand"), F.lit("Expand what works")),
        _row("driver_actions", F.col("top_region"), "follow_up", F.lit(3), F.lit("replicate"), F.lit("Document and share practices")),
        _row("drivers", F.lit(None), "top_dept_share", sh,
             F.when(sh > 30, "over_concentrated").otherwise("balanced_portfolio"),
             F.format_string("Top department holds %.1f%% of sales", sh)),
        # follow-up entities (R5/R6): weakest store, strongest store, top department
        _row("actions", F.coalesce(F.col("worst_store"), F.col("sb_bottom")), "follow_up", F.lit(1),
             F.lit("recover"), F.lit("Recovery plan")),
        _row("actions", F.coalesce(F.col("best_store"), F.col("sb_top")), "follow_up", F.lit(2),
             F.lit("replicate"), F.lit("Document and share practices")),
        _row("actions", F.col("db_top"), "follow_up", F.lit(3), F.lit("promote"), F.lit("Increase promotional focus")),
    ]
    return (m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .where("_keep").drop("_keep"))
