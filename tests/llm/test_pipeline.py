import hashlib
import re
from collections import Counter

import pytest
import tiktoken

import corpus_pipeline as c
from tillroll.llm import bpe

D = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, "en", "src0", 0), (90002, "", None, None, None), (90003, "a@b.cc " + "the and of " * 30, "en", None, 7)], docs.schema)
    docs, out = docs.union(extra), []
    for name, stage in c.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, D).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_are_kept(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_rejects_only_what_has_none(steps):
    before, after = steps[0]
    ids = {r.doc_id for r in after.collect()}
    assert not ids & {90001, 90002} and len(ids) >= 0.97 * before.count()


def test_no_linked_pair_stays_and_nothing_else_goes(steps):
    before, after = ({r.doc_id: shingles(r.text) for r in x.collect()} for x in steps[1])
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    kept = sorted(after)
    assert not any(linked(after[a], after[b]) for i, a in enumerate(kept) for b in kept[i + 1:])
    assert all(any(k < d and linked(before[d], before[k]) for k in before) for d in set(before) - set(after))


def test_redaction_leaves_no_base_span(steps):
    before, after = ({r.doc_id: r for r in x.collect()} for x in steps[2])
    assert set(before) == set(after)
    for r in after.values():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text) and r.n_chars == len(r.text)
    assert "[EMAIL]" in after[90003].text


def test_mix_repeats_whole_documents(steps):
    before, after = steps[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert all(r.text == texts[r.doc_id] for r in rows) and max(Counter(r.doc_id for r in rows).values()) <= 3
    words = lambda x: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in x)
    assert words(r.text for r in rows) == pytest.approx(words(texts.values()), rel=0.2)


def test_tokens_equal_the_public_library(steps):
    before, after = steps[4]
    vocabulary, pattern = bpe.public_vocabulary()
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(vocabulary), special_tokens={})
    want = Counter()
    for r in before.collect():
        ids = ref.encode_ordinary(r.text)
        want[(r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect())


def test_tokens_holds_one_worker_for_each_task(spark):
    """Encoding and decoding are not evaluated side by side in one stage."""
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(20)
    plan = c.tokens(spark, docs, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_empty_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, D)
    assert docs.count() == 0


def test_repeated_and_missing_ids_are_rows_of_their_own(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "x"), (1, "quite another text that has more than five words", "x"), (1, text, "y"), (2, text.upper(), "z"), (None, text, "n"), (None, text, "n"),
            (3, None, "e"), (3, "", "e")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(1, "quite another text that has more than five words", "x"), (1, text, "x"), (3, None, "e"), (3, "", "e"), (None, text, "n"), (None, text, "n")], key=str)
    for parts in (1, 5):
        got = c.near_duplicates(spark, docs.repartition(parts), D).collect()
        assert sorted(((r.doc_id, r.text, r.source) for r in got), key=str) == want


def test_columns_of_any_name_pass_through(spark):
    names = ["_own", "_spans", "mix_size", "mix_copies", "size", "_node", "accepted", "component_id", "a.b", "spans", "_row"]
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    docs = docs.select("*", *[(docs.doc_id * 10 + i).alias(n) for i, n in enumerate(names)])
    for name, stage in c.STAGES[:-1]:
        docs = c.cut_lineage(stage(spark, docs, D), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    rows = docs.collect()
    assert rows and all(r[n] == r.doc_id * 10 + i for r in rows for i, n in enumerate(names))
