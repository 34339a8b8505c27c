"""Byte-level BPE encoding and decoding with a hand-serialised sentencepiece model.

The vocabulary (a file of base64 token bytes and ranks) is turned into the
protocol-buffer message of a sentencepiece BPE model: every byte becomes one
private character, a token becomes the piece of its characters, and the
piece's score is the negated rank, so that sentencepiece's "best score first,
leftmost first" merging is the "lowest rank first, leftmost first" merging of
byte-level BPE.  The normaliser is the identity (no dummy prefix, no removal
or escape of white space).  Texts are split by the vocabulary's pattern first;
each pre-token is encoded by itself.  Decoding maps ids back to token bytes.

Defined results: null and empty texts have no ids and decode to empty bytes;
equal texts have equal ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, drained, kept, need, small_batches

#: Pre-tokens remembered by a worker before its memory starts afresh.
CACHE_TOKENS = 100_000
#: Bytes of text that are split at once (each pre-token is an object of its own).
BLOCK = 1 << 17
#: Byte b is written as the character FIRST_CHAR + b: one character per byte, none of them white space.
FIRST_CHAR = 0x100

# Field numbers and enumerators of sentencepiece's public model message.
MODEL_PIECES, MODEL_TRAINER, MODEL_NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TYPE_NORMAL, TYPE_UNKNOWN = 1, 2
TRAINER_MODEL_TYPE, TRAINER_VOCAB_SIZE = 3, 4
TRAINER_UNK, TRAINER_BOS, TRAINER_EOS, TRAINER_PAD = 40, 41, 42, 43
MODEL_TYPE_BPE = 2
NORMALIZER_NAME, NORMALIZER_DUMMY_PREFIX, NORMALIZER_REMOVE_SPACES, NORMALIZER_ESCAPE = 1, 3, 4, 5


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _piece(text: str, score: float, kind: int) -> bytes:
    return (_block(PIECE_TEXT, text.encode()) + _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score)
            + _number(PIECE_TYPE, kind))


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; piece 0 is the unknown piece, piece i + 1 the i-th token by rank."""
    parts = [_block(MODEL_PIECES, _piece("<unk>", 0.0, TYPE_UNKNOWN))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(chr(FIRST_CHAR + b) for b in token)
        parts.append(_block(MODEL_PIECES, _piece(text, -float(rank), TYPE_NORMAL)))
    trainer = (_number(TRAINER_MODEL_TYPE, MODEL_TYPE_BPE) + _number(TRAINER_VOCAB_SIZE, len(ranks) + 1)
               + _number(TRAINER_UNK, 0) + _number(TRAINER_BOS, -1) + _number(TRAINER_EOS, -1) + _number(TRAINER_PAD, -1))
    normalizer = (_block(NORMALIZER_NAME, b"identity") + _number(NORMALIZER_DUMMY_PREFIX, 0)
                  + _number(NORMALIZER_REMOVE_SPACES, 0) + _number(NORMALIZER_ESCAPE, 0))
    return b"".join(parts) + _block(MODEL_TRAINER, trainer) + _block(MODEL_NORMALIZER, normalizer)


class Codec:
    """Encoder of one vocabulary inside a worker."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(vocabulary)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks), num_threads=1)
        self.rank_of_piece = np.array([0, *sorted(self.ranks.values())], dtype="<u4")
        self.cache: dict[str, bytes] = {}

    def _encode_new(self, pre_tokens: list[str]) -> None:
        """Remember the ids of pre-tokens not seen before."""
        if len(self.cache) + len(pre_tokens) > CACHE_TOKENS:
            self.cache.clear()
        table = {b: chr(FIRST_CHAR + b) for b in range(256)}
        rest = []
        for t in pre_tokens:
            # a pre-token that is itself a token is that token, whatever merging would make of it
            rank = self.ranks.get(t.encode())
            if rank is None:
                rest.append(t)
            else:
                self.cache[t] = struct.pack("<I", rank)
        mapped = [t.encode().decode("latin-1").translate(table) for t in rest]
        for t, pieces in zip(rest, self.model.encode(mapped) if mapped else (), strict=True):
            self.cache[t] = self.rank_of_piece[pieces].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.cache)
        if len(new) + len(self.cache) > CACHE_TOKENS:
            self.cache.clear()
            new = set().union(*split)
        if new:
            self._encode_new(sorted(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, pre)) for pre in split]


@kept
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


@kept
def tokens_by_rank(vocabulary: bytes) -> dict[int, bytes]:
    """All that decoding needs: a worker that only decodes builds no encoder."""
    return {rank: token for token, rank in read_ranks(vocabulary).items()}


def text_of(ids: bytes, token_of: dict[int, bytes]) -> bytes:
    return b"".join(map(token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the binary column ``ids``: each text's ids as little-endian unsigned 32-bit integers.

    ``vocabulary`` is the content of a rank file (under 1 MB; it travels with
    the job).  Other columns stay as they are; a column named ``ids`` is replaced.
    """
    need(df, text)
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, pattern))

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(*shared.value)
        for texts in drained(batches, codec, tokens_by_rank):
            out: list[bytes] = []
            for a, b in blocks(texts, BLOCK):
                out += own.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
            yield pa.array(out, pa.binary())

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, vocabulary: bytes, ids: str = "ids", decoded: str = "decoded", alone: bool = False) -> DataFrame:
    """``df`` with the binary column ``decoded``: the bytes that the ids stand for; null ids give empty bytes.

    ``alone``: nothing is encoded in the same stage, so workers drop their encoder.
    """
    need(df, ids)
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tokens_by_rank(shared.value)
        for rows in drained(batches, tokens_by_rank, *([] if alone else [codec])):
            yield pa.array([text_of(x or b"", own) for x in rows.to_pylist()], pa.binary())

    return df.withColumn(decoded, run(F.col(ids)))


def n_tokens(ids: Column) -> Column:
    return (F.coalesce(F.octet_length(ids), F.lit(0)) / 4).cast("long")


def ids_array(ids: Column) -> Column:
    """The ids as an array of integers, for readers that want no binary."""
    at = F.sequence(F.lit(0), F.greatest(F.octet_length(ids), F.lit(4)) - 4, F.lit(4))
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i + k + 1, F.lit(1))), 16, 10).cast("long")
    every = F.transform(at, lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216)
    return F.when(F.octet_length(ids) > 0, every).otherwise(F.array().cast("array<bigint>"))


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """Content and split pattern of an installed public vocabulary, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def digests(df: DataFrame, vocabulary: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode, and report both by digest: one row per row of ``df``."""
    coded = encode(df.select(key, F.col(text).alias("_text")), vocabulary, pattern, "_text", "_ids").drop("_text")
    both = decode(coded, vocabulary, "_ids", "_decoded")
    return both.select(key, n_tokens(F.col("_ids")).alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"),
                       F.sha2("_decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, *public_vocabulary())
