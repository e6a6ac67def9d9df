"""The registered queries of this subpackage: each applies its operator to a whole table and
returns the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartweave.llm import ann, bpe, chunk_dedup, langid, merkle, mixing, neardup, oracle, quality, search, sharding, spelling, token_counts, toxicity


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file, the same on every machine of the cluster."""
    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.round_trip(_documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_documents(spark, sf_dir), F.col("doc_id") % 50 == 0)


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long")
    crc = F.crc32(F.coalesce(F.encode("text", "utf-8"), F.lit(b"").cast("binary")))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    placed = sharding.number_slots(sharding.assign_shards(rows, "doc_id", 8, grown="grown_shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_spans(_documents(spark, sf_dir))


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within_limit")


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_documents(docs.select("doc_id", "text"), quality.fit_on_labels(docs, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    langs, table = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict_languages(docs.select("doc_id", "text"), langs, table)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(_documents(spark, sf_dir))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "source", "times", "shards")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    folded = merkle.fold(merkle.build(merkle.document_leaves(_documents(spark, sf_dir), tampered)))
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(_documents(spark, sf_dir))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(docs.select("doc_id", "text"), toxicity.fit_on_labels(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


ALL = (
    op1_byte_bpe,
    op2_bm25_top_k,
    op3_jump_shards,
    op4_repeated_spans,
    op5_posting_lists,
    op6_token_counts,
    op7_line_quality,
    op8_language_mixture,
    op9_near_duplicates,
    op10_source_mix,
    op11_merkle_manifest,
    op12_spelling_forms,
    op13_toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
