"""Bands over entity metrics against a plain loop."""

import datetime as dt

import pytest

from tillroll.operators.entity_findings import BANDS, INF, Band, apply_bands, entity_findings, entity_metrics


def _facts(spark):
    last = dt.date(2024, 3, 31)
    rows = []
    for store, sales in {"up": [100.0] * 7 + [150.0], "down": [100.0] * 7 + [80.0], "new": [50.0], "gone": [70.0] * 6}.items():
        for i, s in enumerate(reversed(sales)):
            back = i + (2 if store == "gone" else 0)
            rows.append((last - dt.timedelta(days=7 * back), store, s))
    rows += [(last, None, 5.0), (None, "up", 9.0), (last, "up", None)]
    return spark.createDataFrame(rows, "date date, store string, weekly_sales double")


def test_metrics_of_each_store(spark):
    got = {r.store: r.asDict() for r in entity_metrics(_facts(spark), "store").collect()}
    assert set(got) == {"up", "down", "new", "gone"}
    assert got["up"]["wow_pct"] == pytest.approx(50) and got["up"]["trend_4wk_pct"] == pytest.approx(12.5)
    assert got["down"]["wow_pct"] == pytest.approx(-20) and got["down"]["current_sales"] == 80
    assert got["new"]["wow_pct"] is None and got["new"]["trend_4wk_pct"] is None and got["new"]["current_sales"] == 50
    assert got["gone"]["current_sales"] is None
    total = 850 + 780 + 50 + 420
    assert got["up"]["share_pct"] == pytest.approx(850 / total * 100) and got["up"]["gap_pct"] == pytest.approx((850 - total / 4) / (total / 4) * 100)


def test_every_rule_fires_at_its_limits_only(spark):
    values = [v for limit in (0, 3, 5, 10, 30) for v in (limit, -limit, limit + 1e-9, -limit - 1e-9)]
    metrics = ["wow_pct", "trend_4wk_pct", "gap_pct", "share_pct", "current_sales"]
    df = spark.createDataFrame([(f"e{i}", *[float(v)] * 5) for i, v in enumerate(values)] + [("none", *[None] * 5)], "store string, " + ", ".join(f"{m} double" for m in metrics))
    got = sorted((r.entity, r.metric, r.section, r.rule) for r in apply_bands(df, "store").collect())
    want = sorted((f"e{i}", b.metric, b.section, b.rule) for i, v in enumerate(values) for b in BANDS
                  if (v > b.low or (b.at_low and v == b.low)) and (v < b.high or (b.at_high and v == b.high)))
    assert got == want and {(b.section, b.rule) for b in BANDS} == {(s, r) for _, _, s, r in got}


def test_bands_are_data(spark):
    mine = [Band("gap_pct", 50, True, INF, True, "own", "far_ahead", "far ahead")]
    got = entity_findings(_facts(spark), ["store"], mine).collect()
    assert [(r.kind, r.entity, r.section, r.rule, r.message) for r in got] == [("store", "up", "own", "far_ahead", "up: far ahead")]
    assert entity_findings(_facts(spark).limit(0), ["store"]).count() == 0
