"""The corpus pipeline: language ID, quality rules, near-duplicates, copied passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's result to the shared
folder and reads it again, so no stage carries another's lineage. The stages
themselves are lazy and remove nothing that their result may still read.

Defined results: each stage treats null texts, null ids, repeated rows and empty
tables as its operator does. Rows with a null id take part in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import language_id, near_copies, packing, quality_rules, substring_dedup
from lodestar.llm.common import recorded, remove, scratch, written

#: A document goes if no language can be told or its labels are surer of none than this.
LEAST_LANGUAGE_SCORE = 0.4


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; a missing label is filled by the predicted one. Learned from the labelled documents."""
    model = language_id.train(docs)
    found = language_id.label_documents(docs, model, carry={f"__c{i}": c for i, c in enumerate(docs.columns)})
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.select(*[(F.coalesce(F.col(f"__c{i}"), F.col("lang_pred")) if c == "lang" else F.col(f"__c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are robust outliers of their language and source go."""
    return quality_rules.keep_sound(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays, by id and text (five-word shingles, Jaccard similarity of at least 0.8)."""
    keyed = docs.withColumn("__key", near_copies.row_key(F.col("doc_id"))).withColumn("__node", near_copies.text_node(F.col("text")))
    stay = near_copies.first_copies(docs).select(F.col("key").alias("__key"), F.col("node").alias("__node"))
    return keyed.join(stay, ["__key", "__node"], "left_semi").dropDuplicates(["__key", "__node"]).select(*docs.columns)


def cut_copied_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that an earlier document has go; texts and their lengths follow."""
    carry = {f"__c{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    left = substring_dedup.remove_copied_windows(docs, carry=carry, spaces=True)
    names = {c: F.col(k) for k, c in carry.items()}
    text = F.decode("kept", "UTF-8")
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text}
    if "n_chars" in names:
        names["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return left.select(*[(made | names)[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 tokens."""
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0, ids=False))


STAGES = [
    ("language_id", identify_languages),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_copied_passages),
    ("packing", pack_sequences),
]

#: Neither the language model, the outlier test, XXH64 nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's scratch tables and its predecessor's result go once its own result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        result = scratch(spark, name)
        with recorded() as made:
            docs = written(stage(spark, docs, sf_dir), result)
        for path in [*made, *([before] if before else [])]:
            remove(spark, path)
        before = result
    return docs
