import hashlib
import random

import regex
from pyspark.sql import functions as F

from tillroll.llm import winnow as w


def tokens(text):
    apart = "".join(rf"\p{{{s}}}" for s in w.UNSPACED)
    return regex.findall(rf"[\p{{L}}\p{{N}}\p{{M}}--[{apart}]]{{1,24}}|\S", (text or "").lower(), flags=regex.V1)


def keep(hashes):
    """Positions by the definition: least hash of each window, rightmost of equal ones."""
    if not hashes:
        return []
    out = []
    for s in range(max(1, len(hashes) - w.WINDOW + 1)):
        part = hashes[s:s + w.WINDOW]
        out.append(s + max(i for i, h in enumerate(part) if h == min(part)))
    return sorted(set(out))


def text_of(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["ab", "cd", "e", "the,", "x1", "né", "你", "Z", "Привет", "مرحبا", "ไทย", "हिन्दी"]) for _ in range(n))


TEXTS = [None, "", "  ", "one", "a b c d", "a b c d e", "a " * 300, "x" * 3000, *(text_of(i, 3 * i) for i in range(40)), text_of(1, 5000)]


def test_grams_and_choice_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = df.select("text", w.gram_hashes(F.col("text")).alias("g"), w.fingerprint(F.col("text")).alias("fp"), w.written(w.fingerprint(F.col("text"))).alias("s")).collect()
    seen = {}
    for r in rows:
        t = tokens(r.text)
        grams = [tuple(t[i:i + w.GRAM]) for i in range(max(min(1, len(t)), len(t) - w.GRAM + 1))]
        assert len(grams) == len(r.g)
        for a, b in zip(grams, r.g, strict=True):
            assert seen.setdefault(a, b) == b
        short = [(h % (1 << 64)) >> (64 - w.HASH_BITS) for h in r.g]
        at = keep(short)
        assert [f"{i}:{short[i]:X}" for i in at] == [x for x in r.s.split(",") if x]
    assert len(set(seen.values())) == len(seen)


def test_match_guarantee(spark):
    shared = text_of(99, w.GRAM + w.WINDOW - 1 + 3)
    df = spark.createDataFrame([(1, text_of(3, 50) + " " + shared + " " + text_of(4, 70), text_of(5, 33) + " " + shared)], "a long, t string, u string")
    n = df.select(F.size(F.array_intersect(w.values(w.fingerprint(F.col("t"))), w.values(w.fingerprint(F.col("u")))))).first()[0]
    assert n >= 1


def like(a, b):
    """Twice the shared hashes by both sides' hashes, of two written fingerprints."""
    a, b = ({x.split(":")[1] for x in s.split(",") if x} for s in (a, b))
    return 2.0 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


LETTERS = {"latin": "abcdefghij", "cyrillic": "абвгдежзик", "greek": "αβγδεζηθικ", "arabic": "ابتثجحخدذر", "hebrew": "אבגדהוזחטי", "devanagari": "कखगघचछजझटड", "hangul": "가나다라마바사아자차"}


def test_unrelated_texts_are_unlike_in_every_spaced_script(spark):
    r = random.Random(2)
    for name, letters in LETTERS.items():
        rows = [(i, " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(60))) for i in range(20)]
        out = w.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(x.near_next for x in out) / len(out) < 0.05, name
        assert sum(x.near_edited for x in out) / len(out) > 0.6, name
    han = [(i, "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(80))) for i in range(20)]
    out = w.compare_with_edits(spark.createDataFrame(han, "doc_id long, text string")).collect()
    assert sum(x.near_next for x in out) < 0.5 and sum(x.near_edited for x in out) / len(out) > 0.6


def test_query_against_its_definition(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    rows = {r.doc_id: r for r in w.op6_winnowing(spark, d).collect()}
    assert len(rows) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == like(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == like(r.fingerprint, rows[docs[(k + 1) % len(docs)][0]].fingerprint)
        assert rows[docs[(k + 1) % len(docs)][0]].fingerprint or not tokens(after)
    long = [rows[i] for i, t in docs if len(tokens(t)) > 200]
    assert sum(r.near_edited for r in long) / len(long) > 0.6 > 0.2 > sum(r.near_next for r in long) / len(long)


def test_null_and_repeated_ids_one_row_and_empty(spark):
    rows = [(None, "x y z", 1), (None, None, 2), (4, "abcdefgh", 3), (4, "abcdefgh", 3), (9, "12345678", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = w.compare_with_edits(df).collect()
    assert len(out) == 5
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(r.edited_sha256 for r in out) == sorted([sha("x y a"[:4] + "a"), sha(""), sha("abcdef12"), sha("abcdef12"), sha("123456")])
    assert w.compare_with_edits(df.where("doc_id = 9")).first().near_next == 1.0
    assert w.compare_with_edits(df.limit(0)).count() == 0


def test_equal_texts_and_no_python(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "q"), (3, "a b c d e f")], "doc_id long, text string")
    out = {r.doc_id: r.fingerprint for r in w.compare_with_edits(df).collect()}
    assert out[1] == out[3] != out[2]
    assert not regex.search("Python|Arrow|Pandas", w.compare_with_edits(df)._jdf.queryExecution().toString())


def test_short_texts_keep_several_hashes(spark):
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(8 + i % 13))) for i in range(300)]
    out = w.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(x.fingerprint.count(":") for x in out) / len(out) >= 4
    assert sum(x.near_edited for x in out) / len(out) > 0.5 and sum(x.near_next for x in out) == 0
    # neither none nor all: the share that the edit left is seen
    assert sum(0 < x.near_edited < 1 for x in out) / len(out) > 0.85
