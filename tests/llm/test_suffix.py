import hashlib
import random

import numpy as np
import pyarrow as pa

from tillroll.llm import suffix as s
from tillroll.llm.blocks import joined_bytes
from tillroll.llm.words import RunHasher


def brute(texts):
    """(n_bytes, n_removed, n_spans, sha256) of each text, in order."""
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - s.LENGTH + 1):
            x = data[i:i + s.LENGTH]
            if x in seen:
                gone[i:i + s.LENGTH] = b"\1" * s.LENGTH
            seen.add(x)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(1, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(60):
        t = " ".join(word() for _ in range(r.choice([0, 3, 30, 200])))
        if r.random() < 0.6:
            a, b = sorted((r.randrange(len(passage)), r.randrange(len(passage))))
            t = t[:len(t) // 2] + passage[a:b] + t[len(t) // 2:]
        if texts and r.random() < 0.4:
            old = r.choice(texts) or ""
            a = r.randrange(len(old) + 1)
            t += old[a:a + r.choice([50, 99, 100, 101, 400])]
        texts.append(t)
    return texts + ["z" * 99, "z" * 100, "z" * 101, "z" * 350, None, "", texts[3], texts[3], "ab" * 300, "ba" * 300]


def rows_of(df):
    return {r.doc_id: (r.repeats.n_bytes, r.repeats.n_removed, r.repeats.n_spans, hashlib.sha256(r.repeats.kept).hexdigest()) for r in df.collect()}


def test_every_string_lies_in_one_stretch_with_its_anchor():
    texts = pa.array(corpus(3), pa.string())
    data, starts = joined_bytes(texts)
    found = s.stretches(data, starts, RunHasher(data))
    seen, key_of = set(), {}
    for row, lo, count, key in zip(*[found[c].tolist() for c in ("row", "lo", "count", "key")], strict=True):
        for i in range(lo, lo + count + 1):
            assert (row, i) not in seen
            seen.add((row, i))
            x = data[starts[row] + i:starts[row] + i + s.LENGTH].tobytes()
            assert len(x) == s.LENGTH and starts[row] + i + s.LENGTH <= starts[row + 1]
            assert key_of.setdefault(x, key) == key
    assert len(seen) == sum(max(0, n - s.LENGTH + 1) for n in np.diff(starts))


def test_family_keeps_the_earliest_whatever_the_batches():
    """Equal means equal in both hashes: the same first hash alone joins nothing."""
    r = np.random.default_rng(1)
    n = 5000
    cols = {"key": r.integers(0, 300, n).astype(np.uint64), "check": r.integers(0, 2, n).astype(np.uint64), "doc": r.integers(0, 300, n), "lo": np.arange(n).astype(np.int32)}
    best = {}
    for k, x, d, lo in zip(*[cols[c].tolist() for c in ("key", "check", "doc", "lo")], strict=True):
        best[k, x] = min(best.get((k, x), (d, lo)), (d, lo))
    for size in (n, 700, 50):
        family, out = s.Family(s.STRING), []
        for i in range(0, n, size):
            out += family.add({c: v[i:i + size] for c, v in cols.items()})
            assert all(len(a["key"]) >= 2 * len(b["key"]) for a, b in zip(family.levels, family.levels[1:], strict=False))
        level, more = family.finish()
        got = sum(len(x["key"]) for x in out + more)
        assert got + len(level["key"]) == n
        assert {(int(k), int(x)): (int(d), int(lo)) for k, x, d, lo in zip(*[level[c] for c in ("key", "check", "doc", "lo")], strict=True)} == best


def test_strings_that_agree_in_one_hash_only_are_kept(spark, monkeypatch):
    """A first hash that is the same for all strings: the second one alone decides, and nothing clean goes."""
    class Flat(RunHasher):
        def __init__(self, data):
            # the letters of the corpus have other values where the second hash is taken
            self.plain = not (((data >= 0x30) & (data < 0x40)).any() or (data == 0x20).all())
            super().__init__(data)

        def of(self, start, end):
            h = super().of(start, end)
            self.plain &= not (end - start == s.ANCHOR).any()  # stretches have a hash of their anchor as well
            return np.full_like(h, 7) if self.plain else h
    texts = corpus(11)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(s, "RunHasher", Flat)
    assert rows_of(s.remove_repeats(df)) == dict(enumerate(brute(texts)))


def test_removal_equals_brute_force_also_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(s, "SORT", 40)
    monkeypatch.setattr(s, "BLOCK", 3000)
    texts = corpus(1)
    df = spark.createDataFrame([(3 * i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, repeats string").repartition(4)
    got = rows_of(s.remove_repeats(df))
    for i, want in enumerate(brute(texts)):
        assert got[3 * i] == want, i


def test_long_texts_in_pieces_lose_no_string(spark, monkeypatch):
    """Blocks of one text each, cut every few hundred bytes: the same result as by brute force."""
    texts = corpus(8)
    monkeypatch.setattr(s, "BLOCK", 1)
    monkeypatch.setattr(s, "PIECE", 173)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert rows_of(s.remove_repeats(df)) == dict(enumerate(brute(texts)))


def test_query_on_the_small_table(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    want = dict(zip([i for i, _ in docs], brute([t for _, t in docs]), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.op4_suffix_dedup(spark, d).collect()}
    assert got == want


def test_null_and_shared_ids_and_empty_table(spark):
    x, y = "x" * 120, "abc" * 50
    rows = [(None, x), (5, y), (5, x), (1, None), (None, y)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.repeats.n_removed) for r in s.remove_repeats(df).collect())
    # order: 1, then 5 by text (y before x), then the rows without an id, by text
    want = brute([None, y, x, y, x])
    assert [g[3] for g in got] == [w[1] for w in want]
    assert s.remove_repeats(df.limit(0)).count() == 0
