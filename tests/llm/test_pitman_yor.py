import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import pitman_yor as m

SCHEMA = "doc_id long, text string, score double, pack long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or "")), None]


def base(rows):
    learnt = Counter(t for i, x, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(learnt.values()), len(learnt)
    out = []
    for i, x, *_ in rows:
        t = tokens(x)
        out.append((i, None if i is None else zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(learnt[w] > 0 for w in t), n,
                    round(sum(math.log10((learnt[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)))
    return sorted(out, key=str)


def scored(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = m.score_texts(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return out.collect()


def corpus(seed, docs=250):
    """Texts of a chain in which a word mostly decides the next."""
    r = random.Random(seed)
    follow = {w: [r.randrange(60) for _ in range(3)] for w in range(60)}
    rows = []
    for i in range(docs):
        w, out = r.randrange(60), []
        for _ in range(r.choice([0, 1, 5, 40, 120])):
            w = r.choice(follow[w]) if r.random() < 0.8 else r.randrange(60)
            out.append(f"W{w}" if r.random() < 0.1 else f"w{w}")
        rows.append((i, " \n".join(out), 0.0, 0))
    return rows


def test_base_columns_and_a_better_model(spark, monkeypatch):
    monkeypatch.setattr(m, "PACK", 900)
    rows = corpus(0) + [(1000, None, 0.0, 0), (1001, "", 0.0, 0), (1002, " \t", 0.0, 0), (None, "w1 w2", 0.0, 0), (7, "w1 zebra", 0.0, 0), (7, "w1 zebra", 0.0, 0)]
    got = scored(spark, rows)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in got)
    again = {(r.doc_id, r.n_tokens): r.score for r in got}
    assert again[(1000, 1)] == again[(1001, 1)] == again[(1002, 1)]


def kneser_ney(rows, strength=m.STRENGTH):
    """Scores if every dish of every restaurant, the parent's included, has one table."""
    learnt = [tokens(t) for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    pair = Counter(p for t in learnt for p in zip([None, *t], t, strict=False))
    context, types, names = Counter(), Counter(), Counter()
    for (u, w), c in pair.items():
        context[u] += c
        types[u] += 1
        names[w] += 1
    discount = lambda counts: m._discount(sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))
    d, d0, v = discount(pair), discount(names), len(names)

    def parent(w):
        return (max(names[w] - d0, 0) * (w in names) + (strength + d0 * v) / (v + 1)) / (strength + len(pair))

    def p(u, w):
        if not context[u]:
            return parent(w)
        return ((pair[u, w] - d if (u, w) in pair else 0) + (strength + d * types[u]) * parent(w)) / (strength + context[u])
    assert all(abs(sum(p(u, w) for w in [*names, "not a word"]) - 1) < 1e-9 for u in [*context, "not a word"])
    return [(i, sum(math.log10(p(u, w)) for u, w in zip([None, *tokens(t)], tokens(t), strict=False))) for i, t, *_ in rows]


@pytest.mark.parametrize("split", [False, True])
def test_with_one_table_for_each_dish_equals_brute_force(spark, monkeypatch, split):
    """Probabilities then sum to one by construction; packs, shards and split contexts change nothing."""
    def one_table(c, a, p, d, rng):
        return c.copy(), np.arange(len(c))
    monkeypatch.setattr(m, "PACK", 400)
    monkeypatch.setattr(m, "MOVES", 0)
    monkeypatch.setattr(m, "start", one_table)
    rows = corpus(3, 120) + [(500, "never seen words", 0.0, 0), (501, "", 0.0, 0), (502, None, 0.0, 0), (503, "w1 never w2", 0.0, 0)]
    if split:  # one word before nearly everything: more than a shard's share
        rows = [(i, t and " ".join(f"the {w}" for w in t.split()), s, k) for i, t, s, k in rows]
    got = sorted((r.doc_id, r.score) for r in scored(spark, rows))
    want = sorted(kneser_ney(rows))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-4 * max(1, abs(b)) for (_, a), (_, b) in zip(got, want, strict=True))


def test_split_contexts_give_the_same_scores_within_sampling(spark, monkeypatch):
    monkeypatch.setattr(m, "PACK", 500)
    rows = [(i, " ".join(f"the {w}" for w in t.split()), s, k) for i, t, s, k in corpus(5, 150)]
    one = {r.doc_id: (r.base_score, r.score) for r in scored(spark, rows)}
    real = m.Split.__init__

    def none(self, hashes, sections):
        real(self, hashes[:0], sections[:0])
    monkeypatch.setattr(m.Split, "__init__", none)
    two = {r.doc_id: (r.base_score, r.score) for r in scored(spark, rows)}
    assert all(abs(one[i][0] - two[i][0]) < 1e-6 for i in one)
    assert abs(sum(v[1] for v in one.values()) / sum(v[1] for v in two.values()) - 1) < 0.01


def test_seating_matches_the_restaurant_process():
    """Gibbs moves leave the number of tables distributed as seating one by one does."""
    rng = np.random.default_rng(1)
    d, strength, dishes, n = 0.5, 1.0, 4000, 12
    own = np.arange(dishes)  # every dish in a restaurant of its own; the parent gives it all its mass
    tables = []
    for _ in range(dishes):
        t = 1
        for i in range(1, n):
            t += rng.random() < (strength + d * t) / (strength + i)
        tables.append(t)
    c = np.full(dishes, n)
    size, who = np.full(dishes, n), own
    seats = m.Seats(size, who, dishes, own, np.zeros(dishes))
    for _ in range(900):
        seats.move(c, np.ones(dishes), d, strength, rng)
        assert (np.bincount(seats.own, weights=seats.size, minlength=dishes) == n).all()
    assert abs(seats.t.mean() - np.mean(tables)) < 0.12
    size, who = m.start(c, np.full(dishes, strength), np.ones(dishes), d, rng)
    assert (np.bincount(who, weights=size) == n).all() and (size > 0).all()
    assert abs(len(size) / dishes - np.mean(tables)) < 0.5


def tables_of_a_dish(c, d, rate):
    """Exact mean and variance of the tables of c customers: t tables have the weight (d * rate) ** t times a generalised Stirling number."""
    t = np.arange(c + 1)
    log = np.full(c + 1, -np.inf)
    log[1] = 0.0
    for n in range(1, c):
        stay = log[1:] + np.log(np.maximum(n - d * t[1:], 1e-300))
        log[1:] = np.logaddexp(log[:-1], np.where(t[1:] <= n, stay, -np.inf))
    w = log[1:] + t[1:] * np.log(d * rate)
    w = np.exp(w - w.max())
    mean = (w * t[1:]).sum() / w.sum()
    return mean, (w * t[1:] ** 2).sum() / w.sum() - mean ** 2


@pytest.mark.parametrize(("c", "d", "rate"), [(2, 0.5, 0.5), (5, 0.8, 3.0), (40, 0.3, 1.0), (600, 0.6, 20.0), (600, 0.9, 5.0), (600, 0.4, 300.0), (8, 0.7, 50.0)])
def test_moves_reach_the_exact_number_of_tables(c, d, rate):
    """All customers take part in a move: a dish of many is not held at the one table where it started."""
    dishes, total = 400, 1e9  # tables elsewhere fix the rate
    mean, variance = tables_of_a_dish(c, d, rate)
    rng = np.random.default_rng(3)
    seats, got = m.Seats(np.full(dishes, c), np.arange(dishes), dishes, np.zeros(dishes, np.int64), np.array([total])), []
    for k in range(60):
        seats.move(np.full(dishes, c), np.full(dishes, rate / total), d, 1.0, rng)
        size, own = seats.taken()
        assert (np.bincount(own, weights=size) == c).all() and (size > 0).all()
        if k >= 40:
            got.append(seats.t)
    assert abs(np.mean(got) - mean) < 5 * math.sqrt(variance / dishes / 3)
    assert 0.75 < np.var(got) / variance < 1.3


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)) + "  end"
    whole, n = m.tokens_of(pa.array([text, None, "a B"]))
    monkeypatch.setattr(m, "PIECE", 301)
    cut, k = m.tokens_of(pa.array([text, None, "a B"]))
    assert (whole == cut).all() and n.tolist() == k.tolist() == [5002, 1, 3]


def test_packed_numbers():
    for a in ([], [0], [255, 256], [2 ** 48 + 5, 1], [2 ** 64 - 1, 0]):
        a = np.array(a, np.uint64)
        assert (m.unpack(m.pack(a), np.uint64) == a).all()


def test_empty_tables_and_nothing_to_learn_from(spark):
    assert scored(spark, []) == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = scored(spark, [(only, "a b", 0.0, 0)])
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
