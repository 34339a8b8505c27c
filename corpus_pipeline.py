"""The corpus pipeline: stages applied one after another to ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.

* language: documents whose language can't be told go.
* near_duplicates: of each group of linked documents (five-word shingles,
  similarity 0.8 or more) the first by id, then text, stays.  Every row is a
  document, also where rows repeat an id; rows without an id are no one's
  duplicate and stay.
* personal_data: found spans are replaced by their kind; n_chars follows.
* mix: each document is emitted as often as its source's target asks for.
* tokens: ids of each text, and digests of the ids and of what they decode to.

Null and empty texts are rejected by the first stage; an empty table stays
empty; columns beyond those of ``documents`` pass through unchanged, whatever
their names: stages work on the columns they need and carry the row as one
struct beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, jaccard, langid, mixing, pii
from tillroll.llm.blocks import only_ids
from tillroll.session import cut_lineage


def _row(docs: DataFrame) -> Column:
    """The whole row, carried beside the columns that a stage works on."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = docs.select("doc_id", "text", "lang", "source", _row(docs))
    return langid.identify(kept).where("accepted").select("_own.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = docs.where("doc_id IS NOT NULL")
    repeated = not named.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = named.select("doc_id", "text", _row(docs))
    if repeated:
        # every row gets a number of its own, in the order of ids, texts and the rest of the row
        rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
        rows = mixing.positions(rows, [F.col("doc_id"), F.col("text").asc_nulls_first(), rest], name="_node").select(F.col("_node").alias("doc_id"), "text", "_own")
        rows = cut_lineage(rows, "numbered")
    found = cut_lineage(jaccard.join_components(rows.select("doc_id", "text")), "near-duplicates")
    others = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = only_ids(rows, "doc_id", others, inside=False).select("_own.*")
    return kept.union(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", _row(docs))
    clean = pii.redact(pii.detect(rows, pii.fit(docs), spans="_spans"), spans="_spans")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean.select(*[new.get(c, F.col("_own")[c]).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), _row(docs))
    return mixing.emit(mixing.mix(rows, F.col("size"))).select("_own.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary, pattern = bpe.public_vocabulary()
    # written between the two: in one stage each task would hold a worker for either, beside what the stages before left
    ids = cut_lineage(bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, pattern).drop("text"), "pipeline-ids")
    coded = bpe.decode(ids, vocabulary, alone=True)
    return coded.select("doc_id", "lang", "source", bpe.n_tokens(F.col("ids")).alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]

#: Language models, shared signatures and trees have no SQL form; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs, f"pipeline-{name}")
    return docs
