import hashlib
import math
import random

import numpy as np

from tillroll.llm import centroids as c

SCHEMA = "vec_id long, embedding array<float>, cluster int, q string"


def brute(rows, k, rounds, scale, size):
    kept = []
    for i, v, *_ in rows:
        if v is None or len(v) != size or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, tuple(math.floor(float(np.float32(x)) * scale) for x in v)))
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    now = [q for _, q in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, m)), j) for j, m in enumerate(now)) for _, q in kept]
    for _ in range(rounds):
        where = assign()
        for j in range(len(now)):
            mine = [q for (_, q), (_, w) in zip(kept, where) if w == j]
            if mine:
                now[j] = tuple(sum(x) // len(mine) for x in zip(*mine))
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, assign())), key=str), [list(x) for x in now]


def clustered(spark, rows, **kw):
    got, centers = c.cluster(spark.createDataFrame(rows, SCHEMA).repartition(4), **kw)
    assert got.columns == ["vec_id", "cluster", "distance"]
    return sorted(map(tuple, got.collect()), key=str), centers


def table(seed, count, size):
    r = random.Random(seed)
    centers = [[r.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(centers)], 1, "") for i in range(count)]
    rows += [(i, rows[0][1], 1, "") for i in range(count, count + 30)]
    rows += [(3, rows[0][1], 1, ""), (3, rows[3][1], 1, ""), (None, rows[5][1], 1, ""), (901, None, 1, ""), (902, [0.5] * (size - 1), 1, ""), (903, [None] * size, 1, ""),
             (904, [float("nan")] * size, 1, ""), (905, [float("-inf")] * size, 1, ""), (906, [], 1, "")]
    return rows


def test_equals_brute_force(spark):
    for seed, k in ((0, 8), (1, 3)):
        rows = table(seed, 150, 6)
        assert clustered(spark, rows, k=k, rounds=6, scale=64, size=6) == brute(rows, k, 6, 64, 6)


def test_fewer_vectors_than_centroids_equal_vectors_and_empty(spark):
    few = [(i, [0.1, 0.2], 0, "") for i in range(3)] + [(7, [5.0, 5.0], 0, "")]
    assert clustered(spark, few, k=8, rounds=3, size=2) == brute(few, 8, 3, 1024, 2)
    assert clustered(spark, [], k=8, rounds=3, size=2) == ([], [])


def test_pivots_leave_out_centroids_without_changing_the_nearest():
    r = np.random.default_rng(0)
    centers = r.integers(-900, 900, (12, 64))
    x = (centers[r.integers(0, 12, 3000)] + r.integers(-60, 60, (3000, 64))).astype(np.int64)
    now = centers + r.integers(-30, 30, centers.shape)
    now[7] = now[2]  # a tie
    to_pivot = np.sqrt(np.stack([c.squared(x, p) for p in centers], axis=1).astype(float))
    number, best, computed = c.nearest(x, to_pivot, now, centers)
    every = np.stack([c.squared(x, m) for m in now], axis=1)
    assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert computed < 0.35 * every.size


def test_sums_stay_exact_beyond_doubles(spark):
    rows = [(i, [60000.0 + i, -65000.5], 0, "") for i in range(40)]
    assert clustered(spark, rows, k=2, rounds=2, size=2) == brute(rows, 2, 2, 1024, 2)
