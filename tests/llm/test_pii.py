import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tillroll.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


CASES = [None, "", "a@b.com_x@y.z a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 10.0.0.0", "é 4111 1111 1111 1111ß 4111-1111-1111-1112",
         "+1 (310) 555-4510 x +1 2 +12345678901234567", "9" * 3000, "a" * 3000 + "@", "a.b" * 900 + "@x.y", "1 " * 500 + "🙂 x@y.zz",
         "+1" + " " * 900, "@" * 50, "....1.2.3.4....", "4111111111111111" * 3, "ü" * 40 + "q@w.er,+4930123456 7"]


def noise(seed):
    r = random.Random(seed)
    return "".join(r.choice(["a", "@", ".", "1", "2", "55", "+", " ", "-", "(", ")", "é", "x@y.z", "4111111111111111", "1.2.3.4", "\n"]) for _ in range(120))


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES + [noise(i) for i in range(200)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    return pii.detect(df, pii.Model(None, 0.0)).withColumn("w", pii.written(F.col("spans"))).collect()


def test_base_equals_python(found):
    for r in found:
        assert [x for x in r.w.split(",") if x] == base(r.text), r.text


def test_query_on_the_small_table(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pii.op7_pii(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    more = 0
    for r in rows:
        want = base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
        got = r.spans.split(",") if r.spans else []
        assert got[:len(want)] == want
        more += len(got) - len(want)
    assert more > 0


def test_redaction_merges_overlaps(spark):
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = [(1, "héllo wörld!", [("email", 1, 5), ("card", 3, 8)]), (2, None, None), (3, "abc", []), (4, "abc", [("ip", 0, 3)])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, spans {span}")
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "h[EMAIL]rld!", 2: None, 3: "abc", 4: "[IP]"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(df, pii.fit(df)).count() == 0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    assert not re.search("Python|Arrow|Pandas", pii.detect(df, pii.fit(df))._jdf.queryExecution().toString())


def test_long_secrets_and_codes_are_covered_whole(spark):
    r = random.Random(3)
    value = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(5000))
    rows = [(1, f'é api_key = "{value}" end'), (2, f"é {value} end"), (3, "token=" * 4000), (4, "x" * 100_000 + ".")]
    rng = pii.np.random.default_rng(1)
    every = pii.Model(pii.Trees(rng.normal(size=(40, len(pii.FEATURES))), pii.np.arange(40) % 2.0), -1e9)
    found = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"), every)
    out = {x.doc_id: {(s.kind, s.start, s.end) for s in x.spans} for x in found.collect()}
    assert ("secret", 2, 2 + len(f'api_key = "{value}"')) in out[1] and ("code", 13, 5013) in out[1]
    assert ("code", 2, 5002) in out[2] and out[4] == {("code", 0, 100_000)}
    clean = {x.doc_id: x.text for x in pii.redact(found).collect()}
    assert clean[1] == "é [SECRET] end" and clean[2] == "é [CODE] end"


def test_every_documents_candidates_are_learnt_from(spark):
    """A kind of candidate that stands in two documents out of thousands counts as often as it stands there."""
    rows = [(i, f"order 4111 1111 1111 {i:04d} and 10.0.{i % 300}.1") for i in range(4100)] + [(9000 + i, 'token = "abcdefgh12345678ijklmnop"') for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = pii.labelled(df).collect()
    kind = pii.FEATURES.index("kind")
    of = lambda k: sum(r.n for r in found if r.x[kind] == pii.KINDS.index(k) + 1)
    assert of("secret") == 2 and of("card_like") >= 4100 and of("ip_like") == 4100
    model = pii.fit(df)
    again = pii.fit(df.repartition(3))
    assert (model.trees.trees, model.threshold) == (again.trees.trees, again.threshold)


def test_trees_grown_in_parts_equal_those_of_one_array():
    rng = pii.np.random.default_rng(4)
    x = rng.integers(0, 40, (900, len(pii.FEATURES))).astype(float)
    y = ((x[:, 1] > 20) ^ (x[:, 3] > 30)).astype(float)
    one = pii.Trees(x, y)
    codes = pii.np.stack([pii.np.searchsorted(e, x[:, j]) for j, e in enumerate(one.edges)], axis=1)
    parts = pii.np.array_split(rng.permutation(len(y)), 5)
    two = pii.Trees.grown(one.edges, len(y), y.sum(), lambda *state: sum(pii._sums(*state, codes[p], pii.np.ones(len(p)), y[p]) for p in parts))
    assert one.trees == two.trees and ((one.margin(x) > 0) == (y > 0)).mean() > 0.95
