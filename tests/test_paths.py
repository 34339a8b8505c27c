"""Plan shape, sink and stream paths."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tillroll.operators.filters import apply_filters
from tillroll.plans.pipeline import compute_kpis, write_bundle
from tillroll.session import cluster_conf, scratch_path
from tillroll.sources.rules import fact_rules
from tillroll.sources.tables import dirty_fact, fact_view
from tillroll.streaming.weekly_stream import run_events_weekly

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan_and_fact_is_never_built(spark):
    f = apply_filters(fact_view(spark, SF), {"region": "ASIA", "store": "All"})
    plan = _plan(f)
    assert "EqualTo(r_name,ASIA)" in plan  # pushed into the region scan
    # lineitem is the probe side of every join: the build side is always a dimension
    assert "BuildLeft" not in plan and "BuildRight" in plan


def test_large_dimensions_are_not_broadcast(spark, monkeypatch):
    from tillroll.sources import tables

    want = sorted(map(str, fact_view(spark, SF).groupBy("store").agg(F.sum("weekly_sales")).collect()))
    monkeypatch.setattr(tables, "BROADCAST_MAX_BYTES", 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        f = fact_view(spark, SF)
        assert "BroadcastHashJoin" not in _plan(f) and "SortMergeJoin" in _plan(f)
        assert sorted(map(str, f.groupBy("store").agg(F.sum("weekly_sales")).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_row_tail_limit_runs_before_the_shuffle(spark):
    from tillroll.operators.entities import row_tail_trend

    t = row_tail_trend(fact_view(spark, SF), "store", ties=["l_orderkey", "l_linenumber"])
    s = t._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in s and "Partial" in s


def test_bundle_writes_requested_outputs(spark):
    b = compute_kpis(dirty_fact(spark, SF), fact_rules(), ties=["l_orderkey", "l_linenumber"],
                     outputs=["summary", "regional", "departments_meta"])
    assert set(b) == {"summary", "regional", "departments_meta"}
    path = scratch_path(spark, f"bundle-{uuid.uuid4().hex[:8]}")
    written = write_bundle(b, path)
    assert len(written) == 3
    back = spark.read.parquet(f"{path}/regional")
    assert back.count() == b["regional"].count() > 0
    s = spark.read.parquet(f"{path}/summary").collect()[0]
    assert s.record_count > 0 and s.weeks > 0


def test_stream_weekly_labels_are_sundays(spark):
    out = run_events_weekly(spark, SF, ("event_type",)).collect()
    assert out and all(r.date.weekday() == 6 for r in out)
    total = spark.read.parquet(f"{SF}/events.parquet").count()
    assert sum(r.events for r in out) == total


def test_stream_keeps_every_event_of_many_files_in_any_order(spark, tmp_path):
    from tillroll.streaming.weekly_stream import run_stream

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartitionByRange(96, F.col("ts").desc()).write.parquet(str(tmp_path / "table"))
    want = {(r.date, r.event_type): r.events for r in run_events_weekly(spark, SF, ("event_type",)).collect()}
    out = run_stream(spark, str(tmp_path / "table"), files_per_batch=16).collect()
    assert {(r.date, r.event_type): r.events for r in out} == want
    assert sum(want.values()) == events.count()


@pytest.mark.parametrize("order", ["reversed", "forward", "mixed"])
def test_open_weeks_late_events_and_bounded_folders(spark, tmp_path, order):
    """96 files, one or few in a batch: every event counts, late ones apart, and folders do not pile up."""
    from tillroll.streaming.weekly_stream import stream_into

    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(960):
        rows.append((i, start + dt.timedelta(hours=2 * i), i % 7, "ab"[i % 2], float(i), None))
    files = [rows[k * 10:(k + 1) * 10] for k in range(96)]
    if order == "reversed":
        files.reverse()
    if order == "mixed":
        files = files[:40] + files[70:] + files[40:70]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    folder = tmp_path / "table"
    folder.mkdir()
    for k, f in enumerate(files):
        part = str(tmp_path / f"f{k}")
        spark.createDataFrame(f, schema).coalesce(1).write.parquet(part)
        name = next(x for x in os.listdir(part) if x.startswith("part"))
        os.rename(f"{part}/{name}", folder / f"{k:03d}.parquet")
        os.utime(folder / f"{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    sink = stream_into(spark, str(folder), files_per_batch=6, delay=7, compact=4)
    want, week = {}, lambda t: (t + dt.timedelta(days=6 - t.weekday())).date()
    for _, t, _, kind, v, _ in rows:
        s, n = want.get((week(t), kind), (0.0, 0))
        want[week(t), kind] = (s + v, n + 1)
    assert {(r.date, r.event_type): (r.weekly_sales_sum, r.events) for r in sink.totals().collect()} == want
    # late: the week's last day lies more than the delay before the largest time of the batches before
    late, seen = {}, None
    for b in range(0, 96, 6):
        batch = [r for f in files[b:b + 6] for r in f]
        for _, t, _, kind, _, _ in batch:
            if seen and week(t) < seen.date() - dt.timedelta(days=7):
                late[week(t), kind] = late.get((week(t), kind), 0) + 1
        seen = max([r[1] for r in batch] + ([seen] if seen else []))
    assert {(r.date, r.event_type): r.events for r in sink.late().collect()} == late
    assert bool(late) == (order != "forward")
    open_ = {r.date for r in sink.open_weeks().collect()}
    assert len(open_) <= 4 and max(d for d, _ in want) in open_
    assert len(sink.numbers("batch")) < 4 and len(sink.numbers("base")) == 1 and len(sink.numbers("state")) <= 2
    # a batch that is replayed after it was folded, and one that is replayed before, change nothing
    sink.add(spark.createDataFrame(files[-1], schema), max(sink.numbers("base")))
    assert sum(r.events for r in sink.totals().collect()) == 960


def test_a_replayed_batch_replaces_its_own_output(spark, tmp_path):
    from tillroll.streaming.weekly_stream import Sink

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    batch = lambda days: spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), 1, "a", 1.0, None) for i, d in enumerate(days)], schema)
    sink = Sink(spark, str(tmp_path / "out"), ("event_type",), delay=7, compact=3)
    for number, days in ((0, [0, 1, 30]), (1, [2, 31]), (1, [2, 31]), (2, []), (3, [60, 3])):
        sink.add(batch(days), number)
    assert sum(r.events for r in sink.totals().collect()) == 7 and sum(r.events for r in sink.late().collect()) == 2


def test_csv_is_read_by_header(spark, tmp_path):
    from tillroll.operators.clean import missing_columns
    from tillroll.sources.tables import read_sales_csv

    (tmp_path / "a.csv").write_text('store,date,note,region,transactions,weekly_sales\nS1,2023-01-01,"two\nlines, ""quoted""",NA,7,100.5\n')
    r = read_sales_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(x.store, x.date, x.note, x.region, x.transactions, x.weekly_sales) for x in r] == [
        ("S1", "2023-01-01", 'two\nlines, "quoted"', None, "7", "100.5")]
    (tmp_path / "b.csv").write_text("store,date,weekly_sales,units_sold\nS1,2023-01-01,100.5,7\n")
    b = read_sales_csv(spark, str(tmp_path / "b.csv"))
    assert b.columns == ["store", "date", "weekly_sales", "units_sold"]
    assert "transactions" in missing_columns(b, fact_rules())


def test_missing_columns_give_a_failed_report_and_an_empty_bundle(spark):
    from tillroll.operators.clean import validation_report
    from tillroll.operators.quality import quality_report

    whole = dirty_fact(spark, SF)
    part = whole.drop("weekly_sales")
    r = quality_report(part, fact_rules()).collect()[0]
    assert r.validation_passed is False and r.status == "needs_attention" and r.final_rows == 0
    assert validation_report(part, fact_rules()).columns == validation_report(whole, fact_rules()).columns
    b = compute_kpis(part, fact_rules(), outputs=["kpis_weekly", "regional"])
    assert b["kpis_weekly"].count() == 0 and b["regional"].count() == 0


def test_rules_choose_outlier_method_and_treatment(spark):
    rules = fact_rules()
    rows = {}
    for method, k, treat in (("iqr", 1.5, "flag"), ("zscore", 1.0, "flag"), ("mad", 1.0, "flag"), ("zscore", 1.0, "remove")):
        own = rules | {"outliers": {"group_by": "store", "k": k, "method": method, "treat": treat}}
        rows[method, treat] = compute_kpis(dirty_fact(spark, SF), own, ties=["l_orderkey", "l_linenumber"], outputs=["flagged_rows"])["flagged_rows"]
    flagged = {x: d.where("is_outlier").count() for x, d in rows.items() if x[1] == "flag"}
    assert all(flagged.values()) and len(set(flagged.values())) == 3
    assert rows["zscore", "remove"].count() == rows["zscore", "flag"].count() - flagged["zscore", "flag"]


def test_written_tables_can_be_dropped_at_the_end(spark, monkeypatch):
    from tillroll import session

    monkeypatch.setattr(session, "_written", {})
    kept = session.cut_lineage(spark.range(5).toDF("x"), "drop-me")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 5 and os.path.isdir(path)
    assert session.drop_written(spark) == 1 and not os.path.exists(path)
    assert session.drop_written(spark) == 0


def test_cluster_conf_sizes_from_volume():
    c = cluster_conf(100 * 10**12, executors=1000)
    assert int(c["spark.sql.shuffle.partitions"]) >= 100 * 10**12 // (256 << 20)
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
