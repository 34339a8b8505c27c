"""Scale helpers against brute force on small, skewed fixtures."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.functions.calendar import week_end
from tillroll.functions.carry import carried
from tillroll.functions.ordering import running_totals
from tillroll.functions.quantiles import group_quantiles


def _lin_q(vals, p):
    v = sorted(vals)
    h = (len(v) - 1) * p
    lo, hi = int(np.floor(h)), int(np.ceil(h))
    return v[lo] + (v[hi] - v[lo]) * (h - lo)


def test_group_quantiles_exact_on_skewed_groups(spark):
    """One hot group, spread over several range partitions, and small ones."""
    rnd = random.Random(7)
    rows = []
    # one hot group with a third of the rows and many duplicates, plus small groups
    for i in range(3000):
        rows.append(("hot", float(rnd.choice([0.0, 1.0, 2.5, rnd.randint(0, 500)]))))
    for g in range(30):
        for i in range(rnd.randint(1, 200)):
            rows.append((f"g{g}", float(rnd.randint(-50, 50)) / 4))
    rows.append(("nullv", None))
    rows.append((None, 5.0))
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in group_quantiles(df, ["k"], "x", [0.25, 0.5, 0.75], names=["a", "b", "c"]).collect()}
    assert None not in got and "nullv" not in got
    groups = {}
    for k, x in rows:
        if k is not None and x is not None:
            groups.setdefault(k, []).append(x)
    for k, vals in groups.items():
        assert got[k]["n"] == len(vals)
        for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.75)):
            assert got[k][name] == pytest.approx(_lin_q(vals, p), abs=1e-9)


def test_group_quantiles_global_have_no_keyless_join(spark):
    vals = [float(v) for v in range(1, 1001)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = group_quantiles(df, [], "x", [0.1, 0.9], names=["lo", "hi"])
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    r = q.collect()[0]
    assert group_quantiles(df.where("x < 0"), [], "x", [0.5], names=["m"]).collect()[0]["m"] is None
    assert r["lo"] == pytest.approx(_lin_q(vals, 0.1))
    assert r["hi"] == pytest.approx(_lin_q(vals, 0.9))


def test_running_totals_matches_sorted_prefix(spark):
    rnd = random.Random(3)
    rows = [(f"e{i:03d}", rnd.choice([10, 20, 30, 40])) for i in range(300)]
    df = spark.createDataFrame(rows, "e string, v long")
    out = running_totals(df, [F.col("v").desc(), F.col("e").asc()], "v", num_partitions=7).collect()
    srt = sorted(rows, key=lambda r: (-r[1], r[0]))
    cum = 0
    exp = {}
    for i, (e, v) in enumerate(srt, 1):
        cum += v
        exp[e] = (i, cum)
    for r in out:
        assert (r["rank"], int(r["cum_value"])) == exp[r["e"]]


def _walk(rows):
    """(t -> previous v, store -> sum and count of v) by brute force; rows are (s, d, t, v)"""
    prev, last, total = {}, {}, {}
    for s, d, t, v in sorted(rows, key=lambda r: (str(r[0]), r[1] or dt.date.min, r[2])):
        prev[t] = last.get(s) if s is not None else None
        last[s] = v
        n, x = total.get(s, (0, None))
        total[s] = (n + 1, x if v is None else v + (x or 0))
    return prev, total


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_carried_matches_row_lag_and_totals(spark, parts):
    """One store holds half of all rows, one of its days a third; rows without a store, a date or a value."""
    rnd = random.Random(5)
    base = dt.date(2023, 1, 1)
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        s = "A" if hot else rnd.choice(["A", "B", "C", "D", "D2", None])
        d = base if hot else rnd.choice([None, *[base + dt.timedelta(days=k) for k in range(20)]])
        rows.append((s, d, i, rnd.choice([None, float(rnd.randint(1, 100))])))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, d date, t long, v double").repartition(6)
    got = carried(df, "s", ["d", "t"], prev={"prev": "v", "prev_t": "t"}, totals={"n": F.lit(1), "x": F.col("v")}, position="at",
                  num_partitions=parts).collect()
    prev, total = _walk(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["prev"] == prev[r["t"]]
        assert (r["n"], r["x"]) == total[r["s"]]
    line = [(r["s"] or "", r["d"] or dt.date.min, r["t"]) for r in sorted(got, key=lambda r: r["at"])]
    assert line == sorted(line)


def test_carried_spreads_a_hot_store_day_and_reads_the_input_once(spark):
    rows = [("A", dt.date(2023, 1, 1), i, 1.0) for i in range(1200)] + [(f"s{i % 50}", dt.date(2023, 1, 2), i, 1.0) for i in range(1200, 2400)]
    df = spark.createDataFrame(rows, "s string, d date, t long, v double")
    out = carried(df, "s", ["d", "t"], prev={"p": "v"}, totals={"x": F.col("v")}, position="at", num_partitions=16)
    per = out.where("s = 'A'").groupBy(F.shiftright("at", 40).alias("pid")).count().collect()
    assert len(per) >= 6 and max(r["count"] for r in per) < 400
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan  # what is left to do reads the written rows only
    final = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in final
    assert carried(df.limit(0), "s", ["d"], prev={"p": "v"}, totals={"x": F.col("v")}).count() == 0


def test_week_end_rule(spark):
    # G1: Saturday and Sunday (even at 13:00) belong to the week ending that Sunday; Monday starts the next
    df = spark.createDataFrame(
        [(dt.datetime(2023, 1, 7, 9), ), (dt.datetime(2023, 1, 8, 13), ), (dt.datetime(2023, 1, 9, 0), )], "ts timestamp")
    got = [r[0] for r in df.select(week_end("ts")).collect()]
    assert got == [dt.date(2023, 1, 8), dt.date(2023, 1, 8), dt.date(2023, 1, 15)]


def test_strip_ws_matches_python_strip(spark):
    from tillroll.functions.text import WHITESPACE, strip_ws

    rnd = random.Random(11)
    pool = list(WHITESPACE) + list("ab c")
    vals = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 8))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(strip_ws("s")).collect()]
    assert got == [None if v is None else v.strip() for v in vals]
