import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillroll.llm import mixing
from tillroll.plans.oracle_compare import compare, duck

D = "/root/testdata/sf0.01"


def fill(sizes):
    """Targets by sharing and resharing, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, list(names)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    return target


def test_query_equals_its_sql(spark):
    res = compare(spark, duck(D), "op9", mixing.op9_mix_sources, mixing.OP9_SQL, D)
    assert res["cols_match"] and res["spark_rows"] == res["oracle_rows"] and res.get("match", res.get("hash_match", True)), res


def test_targets_and_takings(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = mixing.op9_mix_sources(spark, D).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, largest, taken, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or ""))
        sizes[s] += r.size
        largest[s] = max(largest[s], r.size)
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


def test_caps_nulls_ties_hot_source(spark):
    rows = [(i, "hot", 10) for i in range(3000)] + [(None, None, 4)] * 50 + [(7, "tiny", 3), (7, "tiny", 3), (8, "tiny", 0), (9, "none", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int").withColumn("size", F.lit("mine"))
    out = mixing.mix(df, F.col("n").cast("long"))
    got = out.collect()
    assert len(got) == len(rows) and {r["size"] for r in got} == {"mine"}
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want, taken = fill(sizes), defaultdict(int)
    for r in got:
        assert r.mix_target == pytest.approx(want[r.source])
        taken[r.source] += r.mix_copies * r.n
    assert taken["tiny"] == 18 and taken["none"] == 0 and taken[None] == 600
    assert abs(taken["hot"] - want["hot"]) <= 10
    assert mixing.emit(out).count() == sum(r.mix_copies for r in got)
    assert sorted(map(str, mixing.mix(df, F.col("n").cast("long")).collect())) == sorted(map(str, got))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n long")
    assert mixing.mix(df, F.col("n")).count() == 0
