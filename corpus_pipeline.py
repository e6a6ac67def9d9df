"""A pipeline over ``documents``, stage by stage; each stage calls an operator of chartweave.llm."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.llm import _shared, bpe, chunk_dedup, mixing, neardup, quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts. Null and empty texts are scored as one empty
    line, very long ones whole; equal texts go or stay together; rows that repeat a doc_id are
    judged each by its own text; an empty table stays empty; further columns are kept."""
    model = quality.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_documents(docs, model, score=_shared.spare(docs, "score"), predicted=_shared.spare(docs, "predicted"))
    return scored.where(F.col(_shared.spare(docs, "predicted")) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of smallest doc_id. Rows with a null
    doc_id and texts without words stay; of rows that repeat a doc_id the one with the smallest
    text stays; very long texts are compared whole; an empty table stays empty; further columns
    are kept."""
    return neardup.keep_one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that documents of smaller doc_id have are cut out. A document of which nothing
    is left goes; null and empty texts and rows with a null doc_id stay as they are; rows that
    repeat a doc_id keep what they share with each other; an empty table stays empty; further
    columns are kept."""
    return chunk_dedup.remove_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources want them, laid out shard by
    shard, in each in the order of the mix. Null and empty texts have no words and go as their
    block goes; a null source is a source; equal rows are taken as often as fits; an empty table
    stays empty; further columns are kept."""
    rows = mixing.mix_documents(docs)
    # shards one behind the other, in ranges that any number of tasks can write
    laid = rows.repartitionByRange("mix_shard", "mix_position").sortWithinPartitions("mix_shard", "mix_position")
    return laid.select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether decoding them gives the text back. Null and empty texts
    have no ids and do give it back; repeated rows are encoded alike, very long texts whole; an
    empty table stays empty; further columns are left behind."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.round_trip(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.encode("text", "utf-8"), F.lit(b"").cast("binary"))
    return decoded.select("doc_id", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens", same.alias("round_trip"))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("substrings", without_repeats),
    ("mix", mixed),
    ("tokens", tokens),
]
#: Classifiers, digests of chunks and draws by hash are beyond SQL; a test holds run() on a small
#: table against the stages done by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet in the shared folder and read
    again. What a stage read is deleted when its own result is written; the last one stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{_shared.shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with _shared.scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _shared.delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
