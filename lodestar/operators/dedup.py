"""Duplicates by content hash and by signature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import hashing

#: Types whose text makes the signature; those of PDF files is made of pages, all others have one of their path.
TEXT_TYPES = (".docx", ".txt", ".md")


def duplicate_groups(files: DataFrame, key: str = "content_hash") -> DataFrame:
    """key, paths (sorted), n of contents that several files have; files without one are left out."""
    grouped = files.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key)
    return grouped.agg(F.sort_array(F.collect_list("path")).alias("paths"), F.count(F.lit(1)).alias("n")).where("n > 1")


def ranked_copies(files: DataFrame, key: str = "signature") -> DataFrame:
    """files with ``keep``: true for the shortest path (then the first by name) of each key.

    The survivor is found by a pre-aggregated minimum and joined back, so a
    signature that a third of all files share is never sorted in one task.
    """
    first = files.groupBy(key).agg(F.min(F.struct(F.char_length("path").alias("n"), F.col("path").alias("p"))).alias("first"))
    return files.join(first, key).withColumn("keep", F.col("path") == F.col("first.p")).drop("first")


def ignore_list(files: DataFrame, key: str = "signature") -> DataFrame:
    return ranked_copies(files, key).where("NOT keep").select("path")


def file_signatures(files: DataFrame, pages: DataFrame, prefix: int) -> DataFrame:
    """path, signature of files (path, size) by their type; pages: path, page_idx, text. A file without pages has one of its path."""
    ends = pages.where("page_idx IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "page_idx").alias("first"), F.max_by("text", "page_idx").alias("last"))
    joined = files.select("path", "size").join(ends, "path", "left")
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    by_type = (
        F.when(F.col("n").isNull(), hashing.path_signature(F.col("size"), F.col("path")))
        .when(kind == ".pdf", hashing.page_signature(F.col("size"), F.col("n"), F.col("first"), F.col("last"), prefix))
        .when(kind.isin(*TEXT_TYPES), hashing.text_signature(F.col("first"), F.col("size"), prefix))
        .otherwise(hashing.path_signature(F.col("size"), F.col("path")))
    )
    return joined.select("path", by_type.alias("signature"))


def not_done(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that an earlier, interrupted run hasn't looked at."""
    return files.join(done.select("path"), "path", "left_anti")


def kept_and_ignored(files: DataFrame, key: str = "signature") -> DataFrame:
    """A row for each group of copies: the kept path and the ignored ones, sorted."""
    ranked = ranked_copies(files, key)
    kept = F.max(F.when(F.col("keep"), F.col("path")))
    return ranked.groupBy(key).agg(kept.alias("kept"), F.sort_array(F.collect_list(F.when(~F.col("keep"), F.col("path")))).alias("ignored")).where(F.size("ignored") > 0)
