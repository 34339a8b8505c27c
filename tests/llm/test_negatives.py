import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import negatives as n

SCHEMA = "vec_id long, label int, embedding array<float>, score string"


def brute(rows, scale=256, positives=5, negatives=3, low=50, high=95, every=5):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) or abs(float(np.float32(x)) * scale) >= n.LARGEST for x in v):
            return None
        return [math.floor(float(np.float32(x)) * scale) for x in v]
    own = [(i, lab, whole(v)) for i, lab, v, _ in rows if i is not None and lab is not None]
    own = [r for r in own if r[2] is not None]
    out = []
    for i, lab, q in own:
        if i % every:
            continue
        score = [(sum(a * b for a, b in zip(q, w)), j, k) for j, k, w in own if j != i]
        best = sorted((-s, j) for s, j, k in score if k == lab)[:positives]
        for p, j in best:
            fit = sorted((-s, m) for s, m, k in score if k != lab and low * -p <= 100 * s <= high * -p)[:negatives]
            out += [(i, j, r + 1, m, -p, -s) for r, (s, m) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = n.mine(df, F.col("vec_id") % 5 == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(n, "STRIPE", 16)
    monkeypatch.setattr(n, "GROUP", 7)
    monkeypatch.setattr(n, "AT_ONCE", 3)
    r = random.Random(seed)
    center = {k: [r.gauss(0, 1) for _ in range(20)] for k in range(4)}
    rows = []
    for i in range(160):
        k = 0 if r.random() < 0.5 else r.randrange(4)
        v = [c + r.gauss(0, 0.7) for c in center[r.choice([k, 0])]]
        rows.append((i, k, [round(x, 1) for x in v] if r.random() < 0.4 else v, "x"))
    rows += [(200, 1, rows[3][2], "x"), (205, 2, rows[3][2], "x"), (5, 0, rows[9][2], "x"), (5, 0, rows[5][2], "x")]
    rows += [(300, None, rows[0][2], "x"), (None, 1, rows[0][2], "x"), (305, 1, None, "x"), (310, 1, [1.0, None], "x"), (315, 1, [float("nan")], "x"),
             (320, 1, [float("inf")], "x"), (325, 1, [], "x"), (330, 1, [2.0] * 45, "x"), (331, 1, [1.0, -1.0], "x"), (335, 2, [1e30], "x"), (340, 9, [0.0] * 20, "x")]
    assert mined(spark, rows) == brute(rows)


def test_negative_and_zero_scores(spark):
    rows = [(0, 1, [1.0, 0.0], ""), (1, 1, [-1.0, 0.0], ""), (2, 2, [-0.7, 0.0], ""), (5, 3, [0.0, 1.0], ""), (6, 3, [1.0, 0.0], ""), (7, 4, [1.0, 0.0], ""), (8, 4, [2.0, 0.0], "")]
    got = mined(spark, rows)
    assert got == brute(rows)
    # a positive that scores 0 accepts negatives that score 0 only; one that scores less than 0 accepts none
    assert [g[:4] for g in got] == [(5, 6, 1, 0), (5, 6, 2, 1), (5, 6, 3, 2)]


def test_no_rows_no_anchors_one_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0], ""), (2, 1, [1.0], "")]) == []
    assert mined(spark, [(5, 1, [1.0], ""), (10, 1, [1.0], "")]) == []


def test_bounds_hold_and_narrow_segments_are_tighter():
    r = np.random.default_rng(4)
    x, y = np.floor(r.normal(0, 60, (30, 64)) + 40), np.floor(r.normal(0, 60, (50, 64)) - 20)
    true = x @ y.T
    fx, fy = n.summaries(x), n.summaries(y)
    widths = []
    for a, b, length in ((n.coarser(*fx, 4), n.coarser(*fy, 4), 16), (fx, fy, 4)):
        least, most = n.bounds(a, b, length)
        assert (least <= true).all() and (true <= most).all()
        widths.append((most - least).mean())
    assert widths[1] < widths[0]
    direct = x.reshape(30, 4, 16)
    assert np.allclose(n.coarser(*fx, 4)[0], direct.mean(axis=2))
    assert np.allclose(n.coarser(*fx, 4)[1], direct.std(axis=2) * 4)


def test_large_whole_numbers_stay_exact():
    a = np.array([[2.0 ** 24 - 1] * 16, [-(2.0 ** 24 - 3)] * 16])
    assert n.exact(a, a).tolist() == [[sum(int(p) * int(q) for p, q in zip(u, v)) for v in a] for u in a]


def test_pairs_are_filtered_before_they_are_scored(monkeypatch):
    """Vectors in two separate directions: the summaries alone tell them apart."""
    r = np.random.default_rng(0)
    x = np.floor(r.normal(0, 3, (400, 64)) + np.where(np.arange(400) < 40, 100, -100)[:, None])
    t = pa.table({"vec_id": np.arange(400), "label": np.zeros(400, np.int64), "key": np.arange(400), "width": np.zeros(400, np.int32),
                  "q": pa.array(x.astype(np.int32).tolist(), pa.list_(pa.int32()))})
    side, scored = n.Side(t, 64), []
    monkeypatch.setattr(n, "exact", lambda a, b, f=n.exact: scored.append(len(a) * len(b)) or f(a, b))
    key, _, _ = n.best_positives(side, side, 5)
    assert len(key) == 2000 and sum(scored) < 0.95 * 400 * 400


def test_query_columns(spark):
    rows = n.op11_hard_negatives(spark, "/root/testdata/sf0.01").collect()
    assert rows and {r["anchor_id"] % 50 for r in rows} == {0} and {r["rank"] for r in rows} <= {1, 2, 3}
