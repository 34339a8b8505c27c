import pyarrow as pa
import pytest

from tillroll.llm import langid as g

D = "/root/testdata/sf0.01"


def test_documents_agree_with_their_labels(spark):
    rows = g.op2_language_id(spark, D).collect()
    assert len(rows) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert sum(r.language == r.lang for r in rows) / len(rows) > 0.97
    assert sum(r.accepted for r in rows) / len(rows) > 0.98
    assert all(0 <= r.probability <= 1 for r in rows)


def test_pages_use_all_evidence(spark):
    rows = g.language_id_pages(spark, D).collect()
    assert len(rows) == 250
    assert sum(r.language == r.declared for r in rows) / len(rows) > 0.9
    assert {r.suffix for r in rows} <= {"com", "net", "org"}


def test_text_beats_a_wrong_declaration_and_hosts_help_short_texts(spark):
    en, de = "the house and the garden of the old people there with them ", "der hund und die katze sind nicht auf dem alten haus gewesen "
    rows = [(i, en * 3, "en", "a") for i in range(60)] + [(100 + i, de * 3, "de", "b") for i in range(60)]
    rows += [(200, de * 3, "en", "b"), (201, "zzq", None, "b"), (202, "zzq", None, "a"), (203, "xx xx", "fr", None), (204, None, "en", "a"), (205, "", None, None), (206, "12 34 !!", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in g.identify(df).collect()}
    assert out[200].language == "de" and out[201].language == "de" and out[202].language == "en"
    assert not any(out[i].accepted for i in (204, 205, 206)) and out[204].language is None
    assert all(out[i].accepted for i in (0, 100, 200))


def test_random_bytes_are_rejected(spark):
    import random

    r = random.Random(5)
    en = "the house and the garden of the old people there with them "
    rows = [(i, en * 3, "en", "a") for i in range(60)] + [(100, "".join(chr(r.randrange(0x250, 0x3000)) for _ in range(500)), None, "a")]
    out = {r.doc_id: r for r in g.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[0].accepted and not out[100].accepted


def test_without_declarations_and_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "abc", None, "s", "mine"), (2, None, None, None, "mine"), (2, None, None, None, "mine")],
                               "doc_id long, text string, lang string, source string, language string")
    out = g.identify(df).collect()
    assert sorted((r.doc_id, r.language, r.accepted) for r in out) == [(1, None, True), (2, None, False), (2, None, False)]
    assert g.identify(df.limit(0)).count() == 0


def test_a_task_holds_one_worker(spark, monkeypatch):
    """Texts are scored once in a stage, and small tables pass through no Python workers."""
    plans, write = [], g.cut_lineage

    def spied(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    def none(*args):
        raise AssertionError("rows of a list pass through Python workers")

    monkeypatch.setattr(g, "cut_lineage", spied)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", none)
    plans.append(g.identify(docs).where("accepted")._jdf.queryExecution().executedPlan().toString())
    assert [p.count("ArrowEvalPython") for p in plans] == [1, 1]


def test_every_declared_language_is_learnt(spark):
    import random

    r = random.Random(11)
    words = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 8))) for _ in range(30)] for k in range(41)}
    say = lambda lang: " ".join(r.choice(words[lang]) for _ in range(25))
    # 40 languages with 6 rows each beside one with 9,000: each is below a thousandth of the rows
    rows = [(i, say("l00"), "l00", "a") for i in range(9000)]
    rows += [(10000 + 10 * k + j, say(f"l{k:02}"), f"l{k:02}", f"h{k}") for k in range(1, 41) for j in range(6)]
    out = g.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8))
    rare = out.where("doc_id >= 10000").collect()
    assert len(rare) == 240 and {x.language for x in rare} == set(words) - {"l00"}
    assert sum(x.language == x.lang and x.accepted for x in rare) / len(rare) > 0.95


def test_trigrams_do_not_cross_rows():
    a = g.trigrams(pa.array(["abc", "de", None, "abc!"], pa.string()))
    assert list(a[1]).count(0) == 2 and list(a[1]).count(1) == 1 and list(a[1]).count(3) == 3 or list(a[1]).count(0) >= 1
    whole = g.trigrams(pa.array(["abc"], pa.string()))[0]
    assert list(whole) == [x for x, r in zip(*a, strict=True) if r == 0]


@pytest.mark.parametrize("text", ["", "a", "é"])
def test_tiny_texts(text):
    at, row = g.trigrams(pa.array([text], pa.string()))
    assert len(at) == len(row)
