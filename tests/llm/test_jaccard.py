import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import jaccard as j
from tillroll.llm.components import components


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    """component of each row by testing all pairs"""
    sets = sets_of([t for _, t in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {k for x in s for k in index[x] if k > i}
        for k in near:
            n = len(s & sets[k])
            if 100 * n >= 80 * (len(s) + len(sets[k]) - n) and rows[i][0] is not None and rows[k][0] is not None:
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return [(d, len(sets[i]), first[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)]


def edited(r, words, share):
    words = list(words)
    for i in range(len(words)):
        if r.random() < share:
            words[i] = f"e{r.randrange(10 ** 6)}"
    if r.random() < 0.3:
        del words[r.randrange(len(words))]
    return words


def corpus(seed, families=30):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows, i = [], 0
    for f in range(families):
        base = [r.choice(vocab) for _ in range(r.choice([1, 3, 5, 6, 8, 12, 20, 40, 90, 200, 500]))]
        if r.random() < 0.5:
            base = base + passage
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            rows.append((i, " ".join(edited(r, base, r.choice([0, 0.005, 0.02, 0.04])))))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, ""), (None, rows[0][1]), (None, None), (i + 4, rows[0][1].upper())]


@pytest.mark.parametrize("seed", [0, 1])
def test_signatures_of_similar_sets_meet(seed):
    r = np.random.default_rng(seed)
    for size in [1, 2, 4, 5, 7, 9, 11, 14, 18, 25, 40, 77, 130, 300, 900]:
        for _ in range(25):
            a = np.unique(r.integers(0, 1 << 62, size).astype(np.uint64))
            # the most different set that still links
            out = int(r.integers(0, max(1, size // 5 + 1)))
            new = 0
            while (len(a) - out) * 5 >= 4 * (len(a) + new + 1):
                new += 1
            if (len(a) - out) * 5 < 4 * len(a):
                continue
            b = np.unique(np.concatenate([a[out:], r.integers(0, 1 << 62, new).astype(np.uint64)]))
            row, sig = j.signatures([a, b])
            assert set(sig[row == 0] >> 1) & set(sig[row == 1] >> 1), (size, out, new)
            large = {x >> 1 for x in sig if x & 1}
            assert set(sig[row == 0] >> 1) & set(sig[row == 1] >> 1) & large


def test_a_task_gets_one_shard(spark, monkeypatch):
    monkeypatch.setattr(j, "SHARD", 500)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    seen, kind = [], type(docs)
    real = kind.mapInArrow

    def spied(self, f, schema):
        seen.append(self)
        return real(self, f, schema)

    monkeypatch.setattr(kind, "mapInArrow", spied)
    j.shared_signatures(docs, 20 * 500)
    each = seen[-1].groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("shard").alias("n")).collect()
    assert sum(r.n for r in each) == 20 and all(r.n == 1 for r in each)


def test_shared_in_chunks_equals_whole():
    r = np.random.default_rng(3)
    sig, doc = r.integers(0, 500, 4000).astype(np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 900, 4000)

    def groups(parts):
        state, seen = j.Shared(), {}
        for k, (s, d) in enumerate(parts):
            for b, p, x in zip(*[c.to_pylist() for c in state.add(s, d, final=k == len(parts) - 1).columns], strict=True):
                seen.setdefault(b, set()).update((p, x))
        return seen
    assert groups([(sig, doc)]) == groups([(sig[i:i + 700], doc[i:i + 700]) for i in range(0, 4000, 700)])


@pytest.mark.parametrize("ids", [2, 2_000_000])
def test_join_equals_all_pairs_with_small_blocks_and_shuffled_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(j, "MEMBERS", 3)
    monkeypatch.setattr(j, "PAIRS", 7)
    monkeypatch.setattr(j, "OFFERS", 0)
    monkeypatch.setattr(j, "SORT", 500)
    monkeypatch.setattr(j, "BROADCAST_IDS", ids)
    rows = [(None if d is None else d + 10_000 * k, t and f"{t} s{k}") for k in (1, 2) for d, t in corpus(k)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = sorted(map(tuple, j.join_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_blocks_of_a_bucket_meet_each_other_once(spark, monkeypatch):
    """All members of a bucket alike, each in its own component: every pair comes out, whatever the blocks."""
    n = 23
    level = spark.createDataFrame([(b, d, d, n) for b in (1, 2) for d in range(n)], "bucket long, doc long, component long, size long")
    info = spark.createDataFrame([(d, 10 + d % 2, bytes([1] * 10 + [d % 2] + [0] * 245)) for d in range(n)], "doc_id long, n_shingles long, counts binary")
    want = {(a, b) for a in range(n) for b in range(a + 1, n)}
    for members in (4, 1000):
        monkeypatch.setattr(j, "MEMBERS", members)
        assert sorted(map(tuple, j.unlike(level, info).collect())) == sorted(want)


def test_shared_passages_alone_share_few_signatures():
    """Documents that have a third of their shingles in common: two of three partitions seldom hold none but common ones."""
    r = np.random.default_rng(5)
    passage = r.integers(0, 1 << 62, 70).astype(np.uint64)
    sets = [np.unique(np.concatenate([passage, r.integers(0, 1 << 62, 140).astype(np.uint64)])) for _ in range(60)]
    row, sig = j.signatures(sets)
    # buckets without a set of the band signed for are not looked at
    names, n = np.unique(sig[(sig & np.uint64(1)) == 1], return_counts=True)
    assert (n * (n - 1) // 2).sum() < 0.3 * 60 * 59 // 2


def test_query_equals_all_pairs(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, j.op3_ngram_join(spark, d).collect())) == sorted(brute(rows))


def test_shared_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "a b c d e f"), (3, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in j.join_components(df).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert j.join_components(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 4999), (5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50)) and got[5000] == got[4999] == 4999


def test_sets_of_texts():
    texts = ["A b C d e f", "a B", None, "", "x y z w v x y z w v", "é É"]
    assert [len(s) for s in j.shingle_sets(pa.array(texts, pa.string()))] == [len(s) for s in sets_of(texts)]
