import hashlib

import public_tokenizers
import pytest
import tiktoken

from tillroll.llm import bpe
from tillroll.llm.blocks import drained

VOCABULARY, PATTERN = bpe.public_vocabulary()
TEXTS = [None, "", " ", "  \n\t x", "Hello world, it's 2024!!", "é" * 400 + " naïve ß 你好 🙂🙂", "a" * 5000, "x\u0000y z",
         "the the  the   the\n\n\nthe", "!" * 900, "  　 mixed", "don't we'LL 'S", "<|endoftext|>", "ab" * 3000 + " " * 700]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})


def test_ids_equal_the_public_library_and_decode_back(spark, reference):
    rows = [(i, t, "extra", b"mine") for i, t in enumerate(TEXTS)] + [(0, None, "extra", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded binary")
    out = bpe.decode(bpe.encode(df, VOCABULARY, PATTERN), VOCABULARY).withColumn("arr", bpe.ids_array(bpe.F.col("ids"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r.arr) == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_digest_query_on_the_small_table(spark, reference):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = bpe.op10_byte_bpe(spark, d).collect()
    assert {r.doc_id for r in out} == set(texts)
    for r in out:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_every_token_encodes_to_itself(reference):
    own = bpe.Codec(VOCABULARY, PATTERN)
    texts = [t.decode() for t in own.ranks if _valid(t)]
    assert [bytes(x) for x in own.encode(texts)] == [b"".join(i.to_bytes(4, "little") for i in reference.encode_ordinary(t)) for t in texts]


def test_decoding_builds_no_encoder(spark):
    df = spark.createDataFrame([(1, b"\x00\x01\x00\x00\x05\x00\x00\x00"), (2, None)], "doc_id long, ids binary")
    token = {rank: t for t, rank in bpe.read_ranks(VOCABULARY).items()}
    only = b"\n".join(line for line in VOCABULARY.splitlines() if int(line.split()[1]) in (5, 256))  # no encoder can be made of it
    with pytest.raises(ValueError):
        bpe.Codec(only, PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, only).collect()} == {1: token[256] + token[5], 2: b""}


def test_tasks_of_other_stages_drop_the_encoder():
    bpe.codec(VOCABULARY, PATTERN)
    assert list(drained(iter([1, 2]), bpe.codec, bpe.tokens_by_rank)) == [1, 2] and bpe.codec.cache_info().currsize
    assert list(drained(iter([3]))) == [3] and not bpe.codec.cache_info().currsize


def _valid(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(df, VOCABULARY, PATTERN).count() == 0
