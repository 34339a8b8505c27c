"""End-to-end check on an upload that this test writes: messy CSV in, cleaned
rows and metrics out, against the same rules in plain pandas."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.operators import clean as C
from tillroll.operators import entities as E
from tillroll.operators import outliers as O
from tillroll.operators import trends as T
from tillroll.operators import weekly as wk
from tillroll.operators.benchmark import pareto_cut
from tillroll.sources.rules import shipped_rules
from tillroll.sources.tables import read_sales_csv

HEAD = ["region", "date", "store", "weekly_sales", "department", "transactions"]


def upload_rows():
    r = random.Random(23)
    rows = []
    for week in range(26):
        day = dt.date(2023, 1, 1) + dt.timedelta(days=7 * week)
        for store in range(1, 6):
            for dept in r.sample(range(1, 8), 3):
                sales = round(8000 + 900 * dept + 120 * store + r.gauss(0, 700) + (30000 if r.random() < 0.01 else 0), 2)
                rows.append(["North" if store % 2 else " South ", str(day), f"Store_{store}", str(sales), f"Dept_{dept}", str(r.randrange(80, 260))])
    for i in range(0, len(rows), 37):
        rows[i][r.choice([1, 3, 5])] = r.choice(["", "NA", "oops"])
    return rows + [list(rows[i]) for i in (3, 50, 51, 200)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(cleaned by the library, cleaned in pandas)"""
    path = tmp_path_factory.mktemp("upload") / "sales.csv"
    rows = upload_rows()
    path.write_text("\n".join(",".join(x) for x in [HEAD, *rows]) + "\n")
    ours = C.clean(read_sales_csv(spark, str(path)), shipped_rules(), materialize=True)
    p = pd.DataFrame(rows, columns=HEAD)
    p["date"] = pd.to_datetime(p["date"], errors="coerce", format="%Y-%m-%d")
    p = p.dropna(subset=["date"])
    for c in ("region", "store", "department"):
        p[c] = p[c].str.strip()
    for c in ("weekly_sales", "transactions"):
        p[c] = pd.to_numeric(p[c], errors="coerce")
    p = p.drop_duplicates()
    p = p.dropna(subset=["weekly_sales"])
    p["transactions"] = p["transactions"].fillna(p["transactions"].median())
    return ours, p


def test_cleaning_counts_and_median(tables):
    ours, p = tables
    assert ours.count() == len(p) < len(upload_rows())
    tot = ours.agg(F.sum("weekly_sales").alias("s"), F.sum("transactions").alias("t")).collect()[0]
    assert float(tot.s) == pytest.approx(p["weekly_sales"].sum(), abs=1e-4) and tot.t == pytest.approx(p["transactions"].sum())


def test_weekly_series(tables):
    ours, p = tables
    want = p.groupby("date")["weekly_sales"].sum()
    got = {r.date: r for r in wk.weekly_kpis(ours).collect()}
    assert len(got) == len(want) == 26
    growth, ma = want.pct_change(), want.rolling(4, min_periods=1).mean()
    for d, s in want.items():
        r = got[d.date()]
        assert r.weekly_sales_sum == pytest.approx(s) and r.ma_4wk == pytest.approx(ma[d])
        assert r.wow_growth_pct is None if pd.isna(growth[d]) else r.wow_growth_pct == pytest.approx(growth[d], abs=1e-6)
    recent, prior = want.iloc[-4:].mean(), want.iloc[-8:-4].mean()
    assert wk.weekly_trend(ours).collect()[0].trend_4wk == pytest.approx((recent - prior) / prior, abs=1e-6)


def test_store_outliers_and_4wk(tables):
    ours, p = tables
    q = p.groupby("store")["weekly_sales"].quantile([0.25, 0.75]).unstack()
    k = p.join(q, on="store")
    out = k[(k["weekly_sales"] < k[0.25] - 1.5 * (k[0.75] - k[0.25])) | (k["weekly_sales"] > k[0.75] + 1.5 * (k[0.75] - k[0.25]))]
    flagged = O.flag_outliers_iqr(ours, "weekly_sales", "store", 1.5).where("is_outlier")
    assert {r.store: r["count"] for r in flagged.groupBy("store").count().collect()} == out.groupby("store").size().to_dict() != {}
    last = p["date"].max()
    now, before = (p[(p["date"] > last - pd.Timedelta(weeks=a)) & (p["date"] <= last - pd.Timedelta(weeks=b))].groupby("store")["weekly_sales"].sum() for a, b in ((4, 0), (8, 4)))
    for r in T.store_4wk_aligned(ours).collect():
        assert r.last_4w == pytest.approx(now[r.store]) and r.prev_4w == pytest.approx(before[r.store])
        assert r.change == pytest.approx((now[r.store] - before[r.store]) / before[r.store], abs=1e-9)


def test_entities_and_pareto(tables):
    ours, p = tables
    stores, regions = p.groupby("store").sum(numeric_only=True), p.groupby("region").sum(numeric_only=True)
    for r in E.store_metrics(ours).collect():
        assert r.total_sales == pytest.approx(stores["weekly_sales"][r.store]) and r.transactions == pytest.approx(stores["transactions"][r.store])
    got = {r.region: r for r in E.region_metrics(ours).collect()}
    assert set(got) == set(regions.index) and all(got[x].sales == pytest.approx(regions["weekly_sales"][x]) for x in got)
    d = p.groupby("department")["weekly_sales"].sum().sort_values(ascending=False)
    share = d.cumsum() / d.sum() * 100
    ours_d = E.department_metrics(ours).orderBy("rank").collect()
    assert [x.department for x in ours_d] == list(d.index)
    assert all(x.cumulative_pct == pytest.approx(share[x.department], abs=1e-5) for x in ours_d)
    assert E.pareto_meta(E.department_metrics(ours)).collect()[0].pareto_80_count == (share <= 80).sum()
    assert pareto_cut(E.department_metrics(ours)).collect()[0].department == share[share >= 80].index[0]
