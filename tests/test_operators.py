"""Operator semantics on hand-made tables (FIXTURES.md section 5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillroll.operators import benchmark as B
from tillroll.operators import clean as C
from tillroll.operators import efficiency as EF
from tillroll.operators import entities as E
from tillroll.operators import outliers as O
from tillroll.operators import trends as T
from tillroll.operators import weekly as wk
from tillroll.operators.findings import alerts, health_status
from tillroll.sources.rules import default_rules, load_rules, shipped_rules

SCHEMA = "date date, store string, department string, region string, weekly_sales double, transactions long"
D0 = dt.date(2023, 1, 1)  # a Sunday


def sunday(k):
    return D0 + dt.timedelta(weeks=k)


def fact(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_gap_weeks_dense_and_zero_previous(spark):
    # weeks 0, 1 and 4 only: weeks 2, 3 are filled with 0 (G2); growth after a 0 week is NULL
    rows = [(sunday(0), "S1", "D", "R", 10.0, 1), (sunday(1), "S1", "D", "R", 20.0, 2),
            (sunday(4), "S1", "D", "R", 40.0, 4)]
    out = wk.weekly_kpis(fact(spark, rows)).orderBy("date").collect()
    assert [r.weekly_sales_sum for r in out] == [10.0, 20.0, 0.0, 0.0, 40.0]
    assert out[0].wow_growth_pct is None and out[1].wow_growth_pct == 1.0
    assert out[3].wow_growth_pct is None and out[4].wow_growth_pct is None
    assert out[4].ma_4wk == pytest.approx(15.0)


def test_weekly_trend_needs_eight_weeks(spark):
    rows = [(sunday(k), "S1", "D", "R", 10.0 + k, 1) for k in range(7)]
    r = wk.weekly_trend(fact(spark, rows)).collect()[0]
    assert r.trend_4wk is None and r.weeks == 7
    rows = [(sunday(k), "S1", "D", "R", 10.0 if k < 4 else 20.0, 1) for k in range(8)]
    assert wk.weekly_trend(fact(spark, rows)).collect()[0].trend_4wk == pytest.approx(1.0)


def test_empty_input_gives_empty_outputs(spark):
    e = fact(spark, [])
    assert wk.weekly_kpis(e).count() == 0
    assert E.store_metrics(e).count() == 0
    assert O.flag_outliers_iqr(e).count() == 0


def test_missing_column_is_reported(spark):
    df = spark.createDataFrame([(D0, "S1")], "date date, store string")
    assert C.missing_columns(df, default_rules()) == ["department", "region", "transactions", "weekly_sales"]
    with pytest.raises(C.MissingColumnsError):
        C.clean(df, default_rules())


def test_bad_cells_whitespace_dups_and_clip(spark):
    raw = spark.createDataFrame([
        ("2023-01-01", " Store_1\t", "D", "R", "100.5", "3"),
        ("2023-13-01", "Store_1", "D", "R", "1", "1"),            # bad date
        ("2023-01-01", "Store_2", "D", "R", "abc", "2"),          # bad sales -> dropped
        ("2023-01-01", "Store_2", "D", "R", "50", "12.5"),        # fractional int -> NULL -> median
        ("2023-01-01", "Store_2", "D", "R", "50", "12.5"),        # exact duplicate
        ("2023-01-01", "Store_3", None, None, "-5", "20000"),     # clip, fill_unknown
    ], "date string, store string, department string, region string, weekly_sales string, transactions string")
    rules = shipped_rules()
    rules["dataset"]["date_validation"] = {}
    out = {r.store: r for r in C.clean(raw, rules).collect()}
    assert set(out) == {"Store_1", "Store_2", "Store_3"}
    assert float(out["Store_3"].weekly_sales) == 0.0 and out["Store_3"].transactions == 10000.0
    assert out["Store_3"].department == "Unknown" and out["Store_3"].region == "Unknown"
    # median of the remaining transactions (3, NULL, 10000) is 5001.5
    assert out["Store_2"].transactions == pytest.approx(5001.5)
    rep = C.validation_report(raw, rules).collect()[0]
    assert rep.initial_rows == 6 and rep.invalid_dates == 1 and rep.final_rows == 3
    assert rep.negative_sales_raw == 1 and rep.negative_sales == 0


def test_fractional_median_imputed_as_double(spark):
    raw = spark.createDataFrame([(D0, "S", "D", "R", 1.0, 1), (D0, "T", "D", "R", 2.0, 2),
                                 (D0, "U", "D", "R", 3.0, None)], SCHEMA)
    out = {r.store: r.transactions for r in C.apply_null_policy(raw, default_rules()).collect()}
    assert out["U"] == 1.5


def test_outliers_min_group_size_and_global(spark):
    rows = [(sunday(0), "small", "D", "R", v, 1) for v in (1.0, 1.0, 1000.0)]
    rows += [(sunday(0), "big", "D", "R", v, 1) for v in (10.0, 11.0, 12.0, 13.0, 500.0)]
    f = O.flag_outliers_iqr(fact(spark, rows), "weekly_sales", "store", 1.5)
    flagged = {(r.store, r.weekly_sales) for r in f.where("is_outlier").collect()}
    assert flagged == {("big", 500.0)}  # 3-row store is never flagged (O1)
    tbl = O.outlier_table(fact(spark, rows), 1.5, 50).collect()  # O5: no minimum group size
    assert {(r.store, r.sales) for r in tbl} >= {("big", 500.0)}


def test_row_tail_trend_guards_and_department_null(spark):
    rows = [(sunday(k), "S8", "D8", "R", 10.0 if k < 4 else 20.0, 1) for k in range(8)]
    rows += [(sunday(k), "S5", "D5", "R", 10.0, 1) for k in range(5)]
    f = fact(spark, rows)
    st = {r.store: r.trend for r in E.row_tail_trend(f, "store", out="trend").collect()}
    assert st == {"S8": 1.0, "S5": 0.0}
    dp = {r.department: r.trend_4wk for r in E.row_tail_trend(f, "department", absent_as_null=True).collect()}
    assert dp == {"D8": 1.0, "D5": None}


def test_ties_take_smallest_name(spark):
    rows = [(D0, "B", "X", "R", 5.0, 1), (D0, "A", "Y", "R", 5.0, 1), (D0, "C", "X", "R", 1.0, 1)]
    r = E.store_summary(fact(spark, rows)).collect()[0]
    assert r.top_store == "A" and r.bottom_store == "C" and r.store_count == 3
    dept = E.department_metrics(fact(spark, rows)).orderBy("rank").collect()
    assert [d.department for d in dept] == ["X", "Y"]


def test_stale_store_aligned_vs_own_tail(spark):
    rows = [(sunday(k), "live", "D", "R", 10.0, 1) for k in range(10)]
    rows += [(sunday(k), "stale", "D", "R", 10.0, 1) for k in range(3)]
    f = fact(spark, rows)
    assert {r.store for r in T.store_4wk_aligned(f).collect()} == {"live"}  # W9 drops it
    own = {r.store: r for r in T.store_4wk_own_tail(f).collect()}
    assert own["stale"].prev_4w_rounded == 0 and own["stale"].pct_change is None  # W10 keeps it


def test_shares_with_few_categories_and_zero_total(spark):
    rows = [(D0, "S", "a", "R", 3.0, 1), (D0, "S", "b", "R", 1.0, 1)]
    out = B.share_top_n(fact(spark, rows), "department", n=5).collect()
    assert {r.department for r in out} == {"a", "b"}
    assert sum(r.share for r in out) == pytest.approx(1.0)
    zero = [(D0, "S", "a", "R", 0.0, 1), (D0, "S", "b", "R", 0.0, 1)]
    assert all(r.share == 0.0 for r in B.share_top_n(fact(spark, zero), "department", n=1).collect())


def test_constant_y_regression_r2_zero(spark):
    t = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    r = EF.regression(t, "x", "y").collect()[0]
    assert r.r2 == 0.0 and r.slope == pytest.approx(0.0)
    one = spark.createDataFrame([(1.0, 5.0)], "x double, y double")
    assert EF.regression(one, "x", "y").collect()[0].slope == 0.0


def test_health_and_alert_rules(spark):
    df = spark.createDataFrame([(None, 0), (0.06, 2), (0.06, 9), (-0.01, 0)], "t double, o long")
    got = [r[0] for r in df.select(health_status(F.col("t"), F.col("o"))).collect()]
    assert got == ["Inconclusive", "Healthy", "Watch", "Declining"]
    m = spark.createDataFrame([(-0.2, 4, 0.01)], "wow_pct double, store_4wk_decline long, missing_pct double")
    fired = {r.name: r.message for r in alerts(m, shipped_rules()).collect()}
    assert set(fired) == {"Revenue Drop Alert", "Store Performance Alert"}
    assert fired["Revenue Drop Alert"].startswith("Sales changed by -20.0%")


def test_rules_loader_falls_back(tmp_path):
    assert load_rules(str(tmp_path / "missing.yaml")) == default_rules()
    bad = tmp_path / "bad.yaml"
    bad.write_text("a: [unclosed")
    assert load_rules(str(bad)) == default_rules()
    good = tmp_path / "good.yaml"
    good.write_text("kpis:\n  time_freq: M\n")
    assert load_rules(str(good))["kpis"]["time_freq"] == "M"


def test_monthly_frequency(spark):
    rows = [(dt.date(2023, 1, 15), "S", "D", "R", 1.0, 1), (dt.date(2023, 3, 2), "S", "D", "R", 2.0, 1)]
    out = wk.weekly_kpis(fact(spark, rows), freq="M").orderBy("date").collect()
    assert [r.date for r in out] == [dt.date(2023, 1, 31), dt.date(2023, 2, 28), dt.date(2023, 3, 31)]


def test_zero_totals(spark):
    # a date with zero sales (W2), a department with zero sales (A7), zero total
    rows = [(D0, "S1", "Z", "R", 0.0, 1), (D0, "S2", "Z", "R", 0.0, 1),
            (sunday(1), "S1", "A", "R", 5.0, 1)]
    from tillroll.operators.derive import add_derived_fields
    d = {(r.date, r.store): r.revenue_contribution_pct for r in add_derived_fields(fact(spark, rows)).collect()}
    assert d[(D0, "S1")] is None and d[(sunday(1), "S1")] == 100.0
    dept = {r.department: r for r in E.department_metrics(fact(spark, rows)).collect()}
    assert dept["A"].cumulative_pct == 100.0 and dept["Z"].cumulative_pct == 100.0
    zero = [(D0, "S1", "Z", "R", 0.0, 1)]
    z = E.department_metrics(fact(spark, zero)).collect()[0]
    assert z.cumulative_pct is None  # zero total: no division


def test_null_keys_never_form_groups(spark):
    rows = [(D0, None, "D", "R", 10.0, 1), (D0, "S1", None, None, 20.0, 1), (D0, "S1", "D", "R", 30.0, 1)]
    f = fact(spark, rows)
    assert {r.store for r in E.store_metrics(f).collect()} == {"S1"}
    assert {r.department for r in E.department_metrics(f).collect()} == {"D"}
    assert {r.region for r in E.region_metrics(f).collect()} == {"R"}
    flagged = O.flag_outliers_iqr(f, "weekly_sales", "store").collect()
    assert len(flagged) == 3 and not any(r.is_outlier for r in flagged)  # null-key row kept, unflagged
    filled = C.apply_null_policy(f, shipped_rules()).collect()
    assert {r.department for r in filled} == {"D", "Unknown"} and all(r.store for r in filled)


def test_short_histories(spark):
    # 1 and 4 weeks -> previous 0 and change NULL; 5 weeks -> previous = the 1 extra week
    rows = [(sunday(0), "one", "D", "R", 5.0, 1)]
    rows += [(sunday(k), "four", "D", "R", 5.0, 1) for k in range(4)]
    rows += [(sunday(k), "five", "D", "R", 10.0 if k == 0 else 5.0, 1) for k in range(5)]
    own = {r.store: r for r in T.store_4wk_own_tail(fact(spark, rows)).collect()}
    assert own["one"].prev_4w_rounded == 0 and own["one"].pct_change is None
    assert own["four"].prev_4w_rounded == 0 and own["four"].change_text == ""
    assert own["five"].prev_4w_rounded == 10 and own["five"].pct_change == pytest.approx(1.0)
    assert own["five"].change_text == "+100.0%"
    # W11 needs 8 complete weeks: none of these stores qualifies
    assert T.store_4wk_rolling(fact(spark, rows)).count() == 0
    rows8 = [(sunday(k), "eight", "D", "R", 1.0 if k < 4 else 2.0, 1) for k in range(8)]
    r = T.store_4wk_rolling(fact(spark, rows8)).collect()[0]
    assert r.last_4w == 8.0 and r.prev_4w == 4.0 and r.delta == 1.0


def test_all_null_median_keeps_rows(spark):
    # median of nothing -> fill 0 (contract), rows are never dropped by the imputation
    raw = spark.createDataFrame([(D0, "S", "D", "R", 1.0, None), (D0, "T", "D", "R", 2.0, None)], SCHEMA)
    out = C.apply_null_policy(raw, default_rules()).collect()
    assert len(out) == 2 and all(r.transactions == 0.0 for r in out)
    # global fences over an all-null value column: rows kept, nothing flagged
    f = O.flag_outliers_iqr(raw.withColumn("weekly_sales", F.lit(None).cast("double")), "weekly_sales", None)
    assert f.count() == 2 and f.where("is_outlier").count() == 0


def test_sign_class_and_health_use_unrounded_values(spark):
    from tillroll.operators import findings as FD
    from tillroll.operators import weekly as wk

    df = spark.createDataFrame([(-1e-7, 0.0499999), (0.0, 0.05), (None, -1e-9)], "wow_growth_pct double, t double")
    out = wk.wow_sign_class(df).withColumn("h", FD.health_status(F.col("t"), F.lit(0))).collect()
    assert [(r.wow_class, r.h) for r in out] == [("down", "Watch"), ("up", "Healthy"), ("up", "Declining")]


def test_rule_aggregates_follow_the_rules_file(spark):

    rows = [(dt.date(2024, 1, 7), 10.0, 2, 5, "x"), (dt.date(2024, 1, 5), 20.0, None, 1, "y"), (dt.date(2024, 1, 21), None, 4, None, "z"), (None, 9.0, 9, 9, "n")]
    df = spark.createDataFrame(rows, "date date, weekly_sales double, transactions long, units_sold int, customer_segment string")
    rules = {"dataset": {"optional_columns": ["units_sold", "customer_segment", "absent"]},
             "kpis": {"aggregates": {"weekly_sales": ["sum", "min", "count"], "transactions": ["mean"], "absent": ["sum"]},
                      "derived": {"per_row": "weekly_sales_sum / NULLIF(weekly_sales_count, 0)", "left_out": "weekly_sales_std * 2"}}}
    got = sorted(map(tuple, wk.rule_aggregates(df, rules).collect()))
    assert wk.rule_aggregates(df, rules).columns == ["date", "weekly_sales_sum", "weekly_sales_min", "weekly_sales_count", "transactions_mean", "units_sold_sum", "per_row"]
    assert got == [(dt.date(2024, 1, 7), 30.0, 10.0, 2, 2.0, 6.0, 15.0), (dt.date(2024, 1, 14), 0.0, None, 0, None, 0.0, None),
                   (dt.date(2024, 1, 21), 0.0, None, 0, 4.0, 0.0, None)]
    with pytest.raises(ValueError, match="unknown aggregates"):
        wk.rule_aggregates(df, {"kpis": {"aggregates": {"weekly_sales": ["mode"]}}})


def test_iso_dates_are_cast_and_others_tried_by_shape(spark):
    from tillroll.operators.clean import coerce_types
    from tillroll.sources.rules import fact_rules
    texts = ["2024-02-29", "2001-13-01", "02/29/2024", "2024/02/29", "2024-02-29 08:30:00", "x", None]
    out = coerce_types(spark.createDataFrame([(t,) for t in texts], "date string"), fact_rules())
    assert [str(r.date) for r in out.collect()] == ["2024-02-29", "None", "2024-02-29", "2024-02-29", "2024-02-29", "None", "None"]
    assert "RLIKE" in out._jdf.queryExecution().optimizedPlan().toString()
