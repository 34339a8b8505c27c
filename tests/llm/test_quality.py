import re
from collections import Counter

import pyarrow as pa
import pytest

from tillroll.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    spans = [len(w) for w in words]
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup, dup_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup += 1
            dup_chars += sum(map(len, WORD.findall(x)))
        seen.add(x)

    def windows(n):
        return [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]

    def covered(n):
        c = Counter(windows(n))
        return {i + j for i, x in enumerate(windows(n)) if c[x] > 1 for j in range(n)}

    out = {"n_words": len(words), "word_chars": sum(spans), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
           "n_lines": len(lines), "n_dup_lines": dup, "dup_line_chars": dup_chars, "n_repeat_words": len(covered(3))}
    for n in quality.TOP_LIMITS:
        c = Counter(windows(n))
        out[f"top_{n}gram"] = min(1.0, max((k * sum(map(len, x)) for x, k in c.items() if k > 1), default=0) / max(1, sum(spans)))
    for n in quality.DUPLICATE_LIMITS:
        out[f"dup_{n}gram"] = sum(spans[i] for i in covered(n)) / max(1, sum(spans))
    return out


CASES = [None, "", "  \n", "a", "x y z x y z x y z", "a b c\na b c\n\na b c d\n\n", "é ß ß 你好\x0b你好\r\nx", "w " * 3000,
         "\n".join(f"line {i % 7} of many words here" for i in range(60)), "#*$ %&|<> a#b", " ".join(f"w{i * i % 37}" for i in range(500))]


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_measures_equal_brute_force(limit):
    texts = pa.array(CASES, pa.string())
    got = [row for a, b in quality.blocks(texts, limit)
           for m in [quality.measure(texts.slice(a, b - a))] for row in (dict(zip(m, x, strict=True)) for x in zip(*m.values(), strict=True))]
    for text, row in zip(CASES, got, strict=True):
        want = brute(text)
        assert {k: pytest.approx(v) for k, v in want.items()} == row


def test_query_on_the_small_table(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in quality.op8_quality_rules(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        want, r = brute(doc.text), rows[doc.doc_id]
        assert all(r[k] == pytest.approx(v) for k, v in want.items())
        assert r.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r.base_failed and r.kept)


def test_nulls_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, "keep", 7), (1, "a b c", None, None), (1, "a b c", None, None)],
                               "doc_id long, text string, kept string, n_words int")
    out = quality.assess(df).collect()
    assert sorted(r.n_words for r in out) == [0, 3, 3] and not any(r.kept for r in out)
    assert quality.assess(df.limit(0)).count() == 0
