import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import toxicity as t

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def result(spark):
    return t.op5_toxicity(spark, D).collect()


def test_held_out_accuracy(spark, result):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    held = [r for r in result if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in result)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in result)
    y, p = np.array([labels[r.doc_id] for r in held]), np.array([r.predicted for r in held])
    assert p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.04


def test_scores_ignore_ids_and_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = t.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = [r.text for r in docs.limit(50).collect()] + [None, "", "...", "x" * 20000, "idiot " * 30000]
    df = spark.createDataFrame([(i % 3, x, "zz", "y") for i, x in enumerate(texts * 2)], "doc_id long, text string, lang string, score string")
    out = [r.score for r in t.score(df, model).collect()]
    assert out[:len(texts)] == pytest.approx(out[len(texts):])
    assert out[len(texts) - 5] == out[len(texts) - 4] == out[len(texts) - 3] < 0.5
    single = [model.scores(pa.array([x], pa.string()))[0] for x in texts]
    assert single == pytest.approx(out[:len(texts)], abs=1e-5)


def test_pooling_equals_plain_convolution():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 1 << 62, 50).astype(np.uint64)
    model = t.Classifier(words[:30], rng.normal(size=30), 0.0)
    docs = [rng.choice(words, n) for n in (0, 1, 2, 3, 40, 0, 7)]
    best, _ = model.pooled(np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs]))))
    for doc, got in zip(docs, best, strict=True):
        a, b = model.places(doc)
        e = model.table[0][a] + model.table[1][b]
        want = []
        for w, f in zip(t.WIDTHS, model.filters, strict=True):
            rows = [sum(e[i + k] @ f[k] for k in range(w) if i + k < len(doc)) for i in range(len(doc))]
            want += list(np.max(rows, axis=0)) if rows else [0.0] * t.FILTERS
        assert got == pytest.approx(np.array(want), abs=1e-5)


def test_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    assert [r.score for r in t.score(docs, model).collect()] == [0.499, 0.499]
    assert t.score(docs.limit(0), model).count() == 0


def test_thresholds_by_language():
    model = t.Classifier(np.empty(0, np.uint64), np.empty(0), 0.0)
    assert t.best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) == pytest.approx(0.5)
    assert model.thresholds == {}


def test_flag_uses_the_languages_threshold(spark):
    model = t.Classifier(np.empty(0, np.uint64), np.empty(0), 0.0)
    model.thresholds = {"de": 0.2}
    df = spark.createDataFrame([("de", 0.3), ("en", 0.3), (None, 0.6)], "lang string, score double")
    assert [r[0] for r in df.select(t.flagged(model, F.col("lang"), F.col("score"))).collect()] == [True, False, True]


def toy(spark, n, long_ids=()):
    """(documents, labels): every third is toxic by its words; a rare language is one in a hundred."""
    say = lambda i: "you idiot moron fool number " if i % 3 == 0 else "nice garden house tree number "
    rows = [(i, say(i) + str(i % 97) + (" x" * 200_000 if i in long_ids else ""), "xx" if i % 100 < 1 else "en") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    return docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")


def test_thresholds_come_from_all_labels_not_trained_on(spark, monkeypatch):
    monkeypatch.setattr(t, "STEPS", 50)
    docs, labels = toy(spark, 9000)
    # 90 rows of the rare language, about 72 outside the held-out fold; 1,000 rows of sample hold about 11
    model = t.fit(docs, labels, rows=1000)
    assert set(model.thresholds) == {"en", "xx"}


def test_a_long_text_does_not_end_the_sample(spark, monkeypatch):
    docs, labels = toy(spark, 300)
    first = t.sample(docs, labels)[1].k
    monkeypatch.setattr(t, "SAMPLE_BYTES", 100_000)
    docs, labels = toy(spark, 300, {first})
    found = [r.k for r in t.sample(docs, labels)]
    assert len(found) > 200 and first not in found


def test_cut_of_bins_equals_cut_of_scores():
    p, y = np.array([0.1, 0.2, 0.2, 0.7, 0.8, 0.9]), np.array([0, 0, 1, 0, 1, 1])
    low, high, bad, good = np.array([0.1, 0.7, 0.8]), np.array([0.2, 0.7, 0.9]), np.array([1, 0, 2]), np.array([2, 1, 0])
    assert t.best_cut(low, high, bad, good) == t.best_threshold(p, y) == pytest.approx(0.75)
