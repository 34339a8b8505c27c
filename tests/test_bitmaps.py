"""Weekly bitmaps and observed counts against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillroll.functions import bitmaps as B
from tillroll.operators import clean as C
from tillroll.operators.quality import business_sums
from tillroll.sources.rules import fact_rules


def _week(d):
    return d + dt.timedelta(days=6 - d.weekday())


def _rows(seed, stores, n):
    r = random.Random(seed)
    days = [dt.date(2021, 12, 25) + dt.timedelta(days=i) for i in range(40)]
    rows = [(r.choice([None, *days]), None if r.random() < 0.05 else f"s{r.randrange(stores)}", r.randint(0, 9)) for _ in range(n)]
    return rows + [(days[0], "s0", None)] * (n // 3)  # one hot store-day


@pytest.mark.parametrize("stores", [3, 400])
def test_distinct_stores_of_any_weeks_equal_brute_force(spark, stores):
    rows = _rows(1, stores, 900)
    df = spark.createDataFrame(rows, "date date, store string, v long").repartition(5)
    maps = B.weekly_bitmaps(df, sums={"v": F.col("v"), "n": F.lit(1)}, least={"first": F.col("date")}, most={"last": F.col("date")})
    per = {}
    for d, s, _ in rows:
        per.setdefault(d and _week(d), set()).add(s)
    got = {r["_k0"]: r["entities"] for r in B.merged_count(maps, [F.col("week")]).collect()}
    assert got == {w: len(s - {None}) for w, s in per.items()}
    years = {}
    for w, s in per.items():
        years.setdefault(w and w.year, set()).update(s - {None})
    assert {r["_k0"]: r["entities"] for r in B.merged_count(maps, [F.year("week")]).collect()} == {y: len(s) for y, s in years.items()}
    assert B.merged_count(maps).collect()[0]["entities"] == len({s for _, s, _ in rows if s})
    assert B.week_count(maps).collect()[0]["weeks"] == len({w for w in per if w})
    t = maps.agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.min("first").alias("a"), F.max("last").alias("b")).collect()[0]
    dates = [d for d, *_ in rows if d]
    assert (t.v, t.n, t.a, t.b) == (sum(v or 0 for *_, v in rows), len(rows), min(dates), max(dates))


def test_more_entities_than_one_bitmap_holds(spark):
    df = spark.range(70_000).select(F.lit("2024-05-05").cast("date").alias("date"), F.concat(F.lit("s"), "id").alias("store"))
    maps = B.weekly_bitmaps(df)
    assert maps.count() == 3 and B.merged_count(maps).collect()[0]["entities"] == 70_000


def test_no_rows(spark):
    maps = B.weekly_bitmaps(spark.createDataFrame([], "date date, store string"))
    assert B.merged_count(maps).collect()[0]["entities"] == 0 and B.week_count(maps).collect()[0]["weeks"] == 0


def test_business_sums_copy_no_row_for_a_distinct(spark):
    df = spark.createDataFrame(_rows(2, 9, 60), "date date, store string, v long").select("date", "store", F.col("v").alias("weekly_sales"), F.col("v").alias("transactions"))
    for part in business_sums(df, "date", "store", "weekly_sales", "transactions", 10.0):
        assert "Expand" not in part._jdf.queryExecution().executedPlan().toString()


def test_counts_of_an_upload_are_observed_while_it_is_written(spark):
    good = ("2023-01-02", "A", "D", "R", "5", "1")
    rows = [good] * 7 + [("bad", "A", "D", "R", "5", "1")] * 3 + [(None, "A", "D", "R", "-5", "1"), ("2023-01-09", " A ", "D", None, "-2", "3"),
                                                                  ("2023-01-09", "A", "D", None, "-2", "3"), ("2024-02-03", "B", "D", "R", None, None)]
    raw = spark.createDataFrame(rows, "date string, store string, department string, region string, weekly_sales string, transactions string").repartition(4)
    cleaned, counts = C.clean_counted(raw, fact_rules())
    assert counts == {"initial_rows": 14, "invalid_dates": 4, "negative_sales_raw": 3, "first_date": dt.date(2023, 1, 2), "last_date": dt.date(2024, 2, 3)}
    plain = sorted(map(tuple, C.clean(raw, fact_rules()).collect()))
    assert sorted(map(tuple, cleaned.collect())) == plain and len(plain) == 2
    r = C.validation_report(raw, fact_rules()).collect()[0]
    assert (r.initial_rows, r.final_rows, r.rows_removed, r.cleaning_removed, r.negative_sales, r.zero_sales) == (14, 2, 12, 8, 0, 1)
    assert r.error_text == "" and r.warning_text == "4 rows without a valid date; 8 rows removed by cleaning; 1 rows with zero sales"
    none = C.validation_report(raw.drop("store", "region"), fact_rules()).collect()[0]
    assert none.error_text == "missing columns: region, store" and none.initial_rows == 0 and none.initial_cols == 4
    empty = C.validation_report(raw.limit(0), fact_rules()).collect()[0]
    assert (empty.initial_rows, empty.first_date, empty.warning_text, empty.cleaning_removed_pct) == (0, None, "", None)


def test_outlier_methods_differ_and_equal_brute_force(spark):
    """Values on which quartiles, deviation and median distance each flag another set."""
    import numpy as np

    from tillroll.operators import outliers as O

    r = random.Random(4)
    rows = []
    for s, spread in (("a", 1.0), ("b", 30.0), ("c", 0.0), ("d", 5.0)):
        for i in range(120):
            v = 100 + r.gauss(0, spread)
            if s in "ad" and i % 15 == 0:
                v += 6 * spread * r.choice([-1, 1, 0.6])
            rows.append((s, i, None if i % 40 == 7 else round(v, 2)))
    rows += [("e", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 90.0])] + [(None, 1, 1e6), ("f", 0, 5.0)]
    df = spark.createDataFrame(rows, "store string, i long, weekly_sales double").repartition(5)
    by = {}
    for s, i, v in rows:
        if s is not None and v is not None:
            by.setdefault(s, []).append((i, v))

    def flags(rule):
        return {(s, i) for s, vs in by.items() for i, v in vs if rule(v, np.array([x for _, x in vs]))}

    def iqr(v, xs):
        q1, q3 = np.quantile(xs, [0.25, 0.75])
        return len(xs) >= 4 and (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))
    everything = np.array([v for s, _, v in rows if v is not None])
    q1, q3 = np.quantile(everything, [0.25, 0.75])
    want = {"iqr": flags(iqr),
            "zscore": flags(lambda v, xs: len(xs) > 1 and xs.std(ddof=1) > 0 and abs(v - xs.mean()) / xs.std(ddof=1) > 3),
            "mad": flags(lambda v, xs: abs(v - np.median(xs)) > 3 * 1.4826 * np.median(np.abs(xs - np.median(xs)))),
            "global": {(s, i) for s, i, v in rows if v is not None and (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))}}
    got = {"iqr": O.flag_outliers_iqr(df), "zscore": O.flag_outliers_zscore(df), "mad": O.flag_outliers_mad(df), "global": O.flag_outliers_iqr(df, group_by=None)}
    assert {k: {(x.store, x.i) for x in d.where("is_outlier").collect()} for k, d in got.items()} == want
    assert len({frozenset(v) for v in want.values()}) == 4
    assert all(d.count() == len(rows) for d in got.values())
    assert {k: O.outlier_count(df, group_by=g).first()[0] for k, g in (("iqr", "store"), ("global", None))} == {k: len(want[k]) for k in ("iqr", "global")}
    assert len(set(map(tuple, O.flag_outliers_mad(df, group_by=None).where("is_outlier").select("store", "i").collect()))) >= 1
