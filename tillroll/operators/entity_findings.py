"""Findings for every store, region or department at once (R2-R6 per entity).

Rules are rows of a table: a metric, a band of its values, and what to say.
Entity metrics are computed side by side from one table of weekly sums, turned
into (entity, metric, value) rows, and joined to the rules on the metric with
the value inside the band.  A rule is data: a rules file, or a caller, can add
bands without code.  The rules table is as long as the rules (a few dozen
rows) and is the broadcast side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import pct_change, safe_div
from ..functions.scalar import with_row
from ..session import cut_lineage
from .trends import entity_week_sums

INF = math.inf


class Band(NamedTuple):
    """A rule: ``metric`` above ``low`` (or at it) and below ``high`` (or at it)."""

    metric: str
    low: float
    at_low: bool
    high: float
    at_high: bool
    section: str
    rule: str
    text: str


def three_way(metric: str, limit: float, section: str, above: str, inside: str, below: str, texts: tuple[str, str, str]) -> list[Band]:
    """Above ``limit``, from -limit to limit, below -limit."""
    return [Band(metric, limit, False, INF, True, section, above, texts[0]),
            Band(metric, -limit, True, limit, True, section, inside, texts[1]),
            Band(metric, -INF, True, -limit, False, section, below, texts[2])]


#: The contract's thresholds (percent), applied to each entity.
BANDS: list[Band] = [
    *three_way("wow_pct", 10, "momentum", "revenue_jump", "revenue_stable", "revenue_drop", ("sales jumped", "sales are stable", "sales dropped")),
    *three_way("wow_pct", 10, "growth_pulse", "strong_momentum", "flat", "sharp_decline", ("strong week", "flat week", "sharp decline")),
    *three_way("wow_pct", 3, "last_week", "scale_winners", "steady_state", "diagnose_blockers", ("up on last week", "steady", "down on last week")),
    *three_way("trend_4wk_pct", 5, "momentum", "accelerating", "flat_trend", "slowing", ("accelerating", "flat over four weeks", "slowing")),
    Band("trend_4wk_pct", 10, False, INF, True, "pulse", "growth_leader", "grows more than a tenth"),
    Band("trend_4wk_pct", -INF, True, -10, False, "pulse", "declining", "shrinks more than a tenth"),
    Band("gap_pct", 0, False, INF, True, "benchmarks", "above_average", "above the average"),
    Band("gap_pct", -INF, True, 0, True, "benchmarks", "at_or_below_average", "at or below the average"),
    Band("share_pct", 30, False, INF, True, "drivers", "over_concentrated", "holds more than 30 % of sales"),
    Band("share_pct", -INF, True, 30, True, "drivers", "balanced", "holds a balanced share"),
    Band("current_sales", -INF, True, INF, True, "drivers", "current_sales", "sold in the last week"),
]


def entity_metrics(df: DataFrame, entity: str, date: str = "date", sales: str = "weekly_sales") -> DataFrame:
    """One row per entity: sales of the last week of all entities, change on the week before, last four weeks against the
    four before (percent), gap to the entities' mean and share of all sales (percent).  A metric that has no value is null."""
    weeks = cut_lineage(entity_week_sums(df, entity, date, sales), "entity-weeks")
    last = weeks.agg(F.max("date").alias("_last"))
    d = F.col("date")
    between = lambda a, b: (d > F.date_sub("_last", a)) & (d <= F.date_sub("_last", b))
    part = lambda cond: F.sum(F.when(cond, F.col("sales")))
    each = with_row(weeks, last).groupBy(entity).agg(
        F.sum("sales").alias("_all"), part(between(7, 0)).alias("_cur"), part(between(14, 7)).alias("_prev"),
        part(between(28, 0)).alias("_l4"), part(between(56, 28)).alias("_p4"))
    whole = weeks.groupBy(entity).agg(F.sum("sales").alias("_one")).agg(F.sum("_one").alias("_total"), F.count(F.lit(1)).alias("_n"))
    j = with_row(each, whole)
    mean = safe_div("_total", "_n")
    change = lambda now, before: F.when(F.col(before) > 0, pct_change(now, before) * 100)
    return j.select(entity, F.col("_cur").cast("double").alias("current_sales"), change("_cur", "_prev").alias("wow_pct"),
                    change("_l4", "_p4").alias("trend_4wk_pct"), F.try_divide(F.col("_all").cast("double") - mean, mean).alias("_gap"),
                    safe_div("_all", "_total").alias("_share")).select(
        entity, "current_sales", "wow_pct", "trend_4wk_pct", (F.col("_gap") * 100).alias("gap_pct"), (F.col("_share") * 100).alias("share_pct"))


def apply_bands(metrics: DataFrame, entity: str, bands: Sequence[Band] = tuple(BANDS)) -> DataFrame:
    """(entity, metric, value, section, rule, message): a row for every rule whose band holds an entity's value."""
    rules = metrics.sparkSession.createDataFrame([tuple(b._replace(low=float(b.low), high=float(b.high))) for b in bands], "rule_metric string, low double, at_low boolean, high double, at_high boolean, section string, rule string, text string")
    names = [c for c in metrics.columns if c != entity]
    rows = metrics.unpivot([entity], names, "metric", "value").where("value IS NOT NULL")
    v = F.col("value")
    inside = (((v > F.col("low")) | (F.col("at_low") & (v == F.col("low")))) & ((v < F.col("high")) | (F.col("at_high") & (v == F.col("high")))))
    hits = rows.join(F.broadcast(rules), (F.col("metric") == F.col("rule_metric")) & inside)
    return hits.select(F.col(entity).cast("string").alias("entity"), "metric", "value", "section", "rule",
                       F.concat(F.col(entity).cast("string"), F.lit(": "), F.col("text")).alias("message"))


def entity_findings(df: DataFrame, entities: Sequence[str] = ("store", "region", "department"), bands: Sequence[Band] = tuple(BANDS), **cols) -> DataFrame:
    """Findings of every entity of each kind, with a column ``kind``."""
    parts = [apply_bands(entity_metrics(df, e, **cols), e, bands).select(F.lit(e).alias("kind"), "*") for e in entities]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
