"""Run reports as small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.changes import ERROR, INDEXED, NEEDS_OCR, PENDING


def outcome_counts(files: DataFrame) -> DataFrame:
    """status, n, chunks; ``bucket`` says whether the chunks are indexed or pending."""
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("chunk_count", F.lit(0))).alias("chunks")).withColumn("bucket", F.when(F.col("status") == INDEXED, "chunks_indexed").otherwise("chunks_pending"))


def not_indexed(files: DataFrame, shown: int = 5) -> DataFrame:
    """status, n, first (the first ``shown`` paths joined by |), more."""
    rest = files.where(F.col("status") != INDEXED)
    first = rest.withColumn("i", F.row_number().over(Window.partitionBy("status").orderBy("path"))).where(F.col("i") <= shown)
    first = first.groupBy("status").agg(F.array_join(F.sort_array(F.collect_list("path")), "|").alias("first"))
    return rest.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(first, "status").withColumn("more", F.greatest(F.col("n") - shown, F.lit(0)))


def strict_blocked(files: DataFrame) -> DataFrame:
    """One row: files that block a strict run, and the exit code."""
    out = files.agg(*[F.count_if(F.col("status") == s).alias(s) for s in (NEEDS_OCR, PENDING, ERROR)])
    return out.withColumn("exit_code", F.when(F.col(NEEDS_OCR) + F.col(PENDING) + F.col(ERROR) > 0, 2).otherwise(0))


def audit_totals(files: DataFrame) -> DataFrame:
    """One row: files that would be indexed, their pages, pages without text and the share of those."""
    good = files.where(F.col("status").isin(INDEXED, PENDING))
    out = good.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("n_pages"), F.coalesce(F.sum("pages_without_text"), F.lit(0)).alias("n_blank"))
    return out.withColumn("blank_share", F.round(F.col("n_blank") / F.greatest(F.col("n_pages"), F.lit(1)), 6))


def mixed_files(files: DataFrame) -> DataFrame:
    """One row: indexed files that have pages without text, and those pages."""
    mixed = files.where((F.col("status") == INDEXED) & (F.col("pages_without_text") > 0))
    return mixed.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("pages_without_text"), F.lit(0)).alias("n_pages"))


def folder_counts(files: DataFrame, status: str) -> DataFrame:
    return files.where(F.col("status") == status).groupBy(F.element_at(F.split("path", "/"), 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def counted(df: DataFrame, code: str, words: str) -> DataFrame:
    """code, message of a table's number of rows; nothing for an empty one."""
    return df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(code).alias("code"), F.concat(F.col("n").cast("string"), F.lit(f" {words}")).alias("message"))


def listed(df: DataFrame, column: str, code: str, words: str, shown: int = 3) -> DataFrame:
    """As counted, with the first of the values and how many more there are."""
    first = df.orderBy(column).limit(shown).agg(F.array_join(F.sort_array(F.collect_list(column)), ", ").alias("first"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" (+"), (F.col("n") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return n.join(first, F.lit(True)).where("n > 0").select(F.lit(code).alias("code"), F.concat(F.col("n").cast("string"), F.lit(f" {words}: "), F.col("first"), more).alias("message"))


def warnings(overlap: DataFrame, lock_files: DataFrame, duplicates: DataFrame, stale: DataFrame, mixed: DataFrame, shown: int = 3) -> DataFrame:
    """code, message of everything a run should mention; nothing for counts of zero."""
    groups = duplicates.select(F.array_join("paths", " = ").alias("g"))
    out = counted(overlap, "overlap", "file(s) reached through several roots")
    out = out.unionByName(counted(lock_files, "lock_files", "lock file(s) skipped"))
    out = out.unionByName(listed(groups, "g", "duplicates", "group(s) of equal content", shown))
    out = out.unionByName(listed(stale, "path", "stale_ignores", "ignore entr(ies) without a file", shown))
    return out.unionByName(mixed.where("n_files > 0").select(F.lit("mixed").alias("code"), F.concat(F.col("n_files").cast("string"), F.lit(" file(s) with "), F.col("n_pages").cast("string"), F.lit(" page(s) without text")).alias("message")))


def run_warnings(unreachable: DataFrame, kept: int, nested: DataFrame, unreadable: DataFrame, hints: DataFrame, others: DataFrame, shown: int = 3) -> DataFrame:
    """others (of warnings) with what else a run meets: roots out of reach, roots inside others, files that can't be read, files that seem renamed."""
    out = others.unionByName(unreachable.select(F.lit("unreachable").alias("code"), F.concat(F.lit("source not reachable: "), F.col("root"), F.lit(f"; {kept} file(s) kept as they are")).alias("message")))
    out = out.unionByName(nested.select(F.lit("nested").alias("code"), F.concat("inner", F.lit(" is inside "), "outer", F.lit("; its files count once")).alias("message")))
    out = out.unionByName(counted(unreadable, "unreadable", "file(s) could not be read"))
    return out.unionByName(listed(hints.select(F.concat("old_path", F.lit(" -> "), "new_path").alias("h")), "h", "renamed", "file(s) that seem renamed", shown))
