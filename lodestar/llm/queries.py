"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, exact_digest, language_id, packing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_copied_windows(_documents(spark, sf_dir)))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(sharding.shard(_documents(spark, sf_dir), shards=24))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0, ids=False))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op5_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_digest.fingerprint_edits(_documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_with_folds(_documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), words=3, radius=2)
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_with_folds(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_ALL = (op1_substring_dedup, op2_sharding, op3_packing, op4_token_counts, op5_exact_digest, op6_language_id, op7_simhash, op8_quality_rules, op9_bpe, op10_quality_classifier)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
        ), win AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
        ), own AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
        hit AS (
            SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM win JOIN own USING (g) WHERE m < doc_id)
        ), gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
        kept AS (
            SELECT doc_id, len(w) AS n, coalesce(len(ps), 0) AS r,
                   array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(ps, i)] END, ' ') AS k
            FROM d LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(k) AS kept_sha256 FROM kept
    """,
}
