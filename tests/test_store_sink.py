"""The bucketed sink and stored sketches."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tillroll.functions import sketches as S
from tillroll.plans.store_sink import store_weeks, store_years, write_store_weeks
from tillroll.session import scratch_path


def _facts(spark, years, factor=1.0):
    rows = [(dt.date(y, 1, 8) + dt.timedelta(days=7 * w), f"s{i}", factor * (i + 1) * (y - 2000), 2) for y in years for w in range(6) for i in range(9)]
    rows += [(dt.date(years[0], 1, 9), "s0", factor, 1)] * 200 + [(None, "s1", 1.0, 1), (dt.date(years[0], 1, 9), None, 1.0, 1)]
    return spark.createDataFrame(rows, "date date, store string, weekly_sales double, transactions int")


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_and_joins_by_store_read_the_buckets_without_an_exchange(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    write_store_weeks(store_weeks(_facts(spark, [2021, 2022, 2023])), name, scratch_path(spark, name), buckets=4)
    plan = _plan(store_years(spark, name))
    assert "Exchange" not in plan and "Window" in plan
    t = spark.table(name)
    one, two = (t.where(F.col("year") == y).groupBy("store").agg(F.sum("sales").alias(f"s{y}")) for y in (2021, 2023))
    joined = _plan(one.hint("merge").join(two, "store"))
    assert "Exchange" not in joined and "SortMergeJoin" in joined
    got = {(r.store, r.year): r for r in store_years(spark, name).collect()}
    assert len(got) == 27 and got["s3", 2022].sales == 6 * 4 * 22 and got["s3", 2022].change == pytest.approx(1 / 21)
    assert got["s3", 2021].previous_sales is None and got["s3", 2021].weeks == 6
    files = spark.read.parquet(scratch_path(spark, name)).select(F.input_file_name()).distinct().count()
    assert files <= 3 * 4


def test_a_year_written_again_replaces_itself_and_no_other(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    path = scratch_path(spark, name)
    write_store_weeks(store_weeks(_facts(spark, [2021, 2022])), name, path, buckets=4)
    before = {(r.store, r.week): r.sales for r in spark.table(name).collect()}
    for _ in range(2):
        write_store_weeks(store_weeks(_facts(spark, [2022], factor=3.0)), name, path, buckets=4)
    after = {(r.store, r.week): r.sales for r in spark.table(name).collect()}
    assert spark.table(name).count() == len(after)
    assert all(after[k] == v for k, v in before.items() if k[1].year == 2021)
    want = {(r.store, r.week): r.sales for r in store_weeks(_facts(spark, [2022], factor=3.0)).collect()}
    assert {k: v for k, v in after.items() if k[1].year == 2022} == want


def test_merged_sketches_keep_their_error_bounds(spark):
    r = random.Random(3)
    rows = [(dt.date(2024, 1, 7) + dt.timedelta(days=r.randrange(60)), r.choice(["a", "a", "a", "b"]), r.lognormvariate(3, 1), r.randrange(30_000)) for _ in range(40_000)]
    rows += [(dt.date(2024, 1, 7), "none", None, None), (None, "b", 5.0, 1), (dt.date(2024, 1, 7), None, 5.0, 1)]
    kept = S.weekly_sketches(spark.createDataFrame(rows, "date date, store string, v double, k long").repartition(6), "store", "v", "k")
    for by in ([], ["store"], ["store", "week"]):
        for got in S.merged(kept, by, (0.1, 0.5, 0.9)).collect():
            mine = [x for x in rows if x[1] is not None and all(got[c] == (x[1] if c == "store" else x[0] and x[0] + dt.timedelta(days=6 - x[0].weekday())) for c in by)]
            values = sorted(x[2] for x in mine if x[2] is not None)
            assert got["n"] == len(values)
            if not values:
                assert got["q50"] is None and got["distinct"] == 0
                continue
            for p in (0.1, 0.5, 0.9):
                q = got[f"q{int(p * 100)}"]
                below, upto = sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)
                assert below - 2 * S.RANK_ERROR <= p <= upto + 2 * S.RANK_ERROR
            exact = len({x[3] for x in mine if x[3] is not None})
            assert abs(got["distinct"] - exact) <= 1.5 * S.DISTINCT_ERROR * exact + (0 if exact > 4096 else 0)
            if exact < 4000:
                assert got["distinct"] == exact
