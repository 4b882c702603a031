"""What changed between two snapshots of a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW, MODIFIED, MOVED, DELETED, UNCHANGED = TYPES = ("NEW", "MODIFIED", "MOVED", "DELETED", "UNCHANGED")
INDEXED, NEEDS_OCR, PENDING, UNSUPPORTED, EMPTY, ERROR = STATUSES = ("indexed", "needs_ocr", "pending_embedding", "unsupported", "empty", "error")
RETRYABLE = (NEEDS_OCR, PENDING, ERROR)


def move_pairs(new: DataFrame, vanished: DataFrame, match_null: bool = False) -> DataFrame:
    """path, old_path: per content hash the n-th new path and the n-th vanished one, both in order.

    Equal to taking, for every new path in order, the first vanished path of the
    same hash that isn't taken. Files without a hash never match unless asked for.
    """
    by = Window.partitionBy("content_hash").orderBy("path")
    a = new.select("content_hash", "path").withColumn("n", F.row_number().over(by))
    b = vanished.select("content_hash", F.col("path").alias("path")).withColumn("n", F.row_number().over(by))
    b = b.select(F.col("content_hash").alias("old_hash"), F.col("path").alias("old_path"), F.col("n").alias("old_n"))
    same = a["content_hash"].eqNullSafe(b["old_hash"]) if match_null else a["content_hash"] == b["old_hash"]
    return a.join(b, same & (a["n"] == b["old_n"])).select("path", "old_path")


def reprocess_reason(status: Column, attempts: Column, path: Column, blank_pages: Column, stored_ocr: Column, stored_model: Column, max_retries: Column, ocr_print: Column, model_print: Column, can_embed: Column) -> Column:
    """Why an unchanged file is processed again; null if it isn't. ocr_print is null without an engine."""
    ocr = ocr_print.isNotNull()
    other_ocr = ~stored_ocr.eqNullSafe(ocr_print)
    known = (F.coalesce(stored_model, F.lit("")) != "") & (F.coalesce(model_print, F.lit("")) != "")
    rules = [
        (status == NEEDS_OCR, F.when(ocr & other_ocr, F.lit("retry: OCR available"))),
        ((status == ERROR) & (F.coalesce(attempts, F.lit(0)) >= max_retries), F.lit(None).cast("string")),
        (ocr & F.lower(path).endswith(".pdf") & (F.coalesce(blank_pages, F.lit(0)) > 0) & other_ocr, F.concat(F.lit("ocr: "), blank_pages.cast("string"), F.lit(" page(s) without text"))),
        (can_embed & (status == INDEXED) & known & (stored_model != model_print), F.lit("re-embed: embedding model changed")),
        (status.isin(*RETRYABLE) & can_embed, F.concat(F.lit("retry: previous run ended in "), status)),
    ]
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for test, value in rules[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), value)
    return out


def classify(current: DataFrame, previous: DataFrame, reason: Column | None = None, track_moves: bool = True, track_deletions: bool = True) -> DataFrame:
    """phase, path, type, old_path, reason, keep: one row for each current path, then each vanished one.

    reason: an expression over the previous row (columns p_status, p_attempts, ...).
    """
    names = [c for c in previous.columns if c != "path"]
    before = previous.select("path", *[F.col(c).alias(f"p_{c}") for c in names])
    now = current.select("path", F.col("content_hash"), F.lit(True).alias("here"))
    both = now.join(before.withColumn("there", F.lit(True)), "path", "full_outer")
    new = both.where("here AND there IS NULL").select("path", "content_hash")
    vanished = both.where("here IS NULL").select("path", F.col("p_content_hash").alias("content_hash"))
    moves = move_pairs(new, vanished) if track_moves else new.sparkSession.createDataFrame([], "path string, old_path string")
    claimed = moves.select(F.col("old_path").alias("path"), F.lit(True).alias("claimed"))
    all_rows = both.join(moves, "path", "left").join(claimed, "path", "left").where("claimed IS NULL")
    why = reason if reason is not None else F.lit(None).cast("string")
    same = F.col("content_hash").eqNullSafe(F.col("p_content_hash"))
    kind = (
        F.when(F.col("here").isNull(), F.lit(DELETED if track_deletions else UNCHANGED))
        .when(F.col("old_path").isNotNull(), MOVED)
        .when(F.col("there").isNull(), NEW)
        .when(~same | why.isNotNull(), MODIFIED)
        .otherwise(UNCHANGED)
    )
    return all_rows.select(
        F.when(F.col("here").isNull(), 1).otherwise(0).alias("phase"),
        "path",
        kind.alias("type"),
        "old_path",
        F.when(F.col("here") & F.col("there") & same, why).alias("reason"),
        (F.col("here").isNull() & F.lit(not track_deletions)).alias("keep"),
    )


def rewrite_unindexed_moves(changes: DataFrame, previous: DataFrame) -> DataFrame:
    """A file that moved before it was ever indexed is processed as MODIFIED."""
    old = previous.select(F.col("path").alias("old_path"), F.col("status").alias("old_status"))
    never = (F.col("type") == MOVED) & (F.col("old_status").isNull() | F.col("old_status").isin(*RETRYABLE))
    return changes.join(old, "old_path", "left").withColumn("type", F.when(never, MODIFIED).otherwise(F.col("type"))).drop("old_status").select(*changes.columns)


def change_counts(changes: DataFrame) -> DataFrame:
    """type, n for all five types, zeros kept."""
    types = changes.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    return types.join(changes.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def rename_hints(changes: DataFrame, signatures: DataFrame) -> DataFrame:
    """new_path, old_path: a NEW file with the signature of a DELETED one (the last of several by path)."""
    marked = changes.join(signatures.where(F.coalesce("signature", F.lit("")) != ""), "path")
    gone = marked.where(F.col("type") == DELETED).groupBy("signature").agg(F.max("path").alias("old_path"))
    return marked.where(F.col("type") == NEW).select("signature", F.col("path").alias("new_path")).join(gone, "signature").select("new_path", "old_path")


def attempts_after(status: Column, attempts: Column) -> Column:
    return F.when(status.isin(*RETRYABLE), F.coalesce(attempts, F.lit(0)) + 1).otherwise(0)


def carried(moved: DataFrame, old: DataFrame, fields: list[str]) -> DataFrame:
    """moved (path, old_path, fields) takes the old entry's fields over, where those aren't null."""
    before = old.select(F.col("path").alias("old_path"), *[F.col(f).alias(f"o_{f}") for f in fields])
    return moved.join(before, "old_path", "left").select("path", "old_path", *[F.coalesce(f"o_{f}", f).alias(f) for f in fields])


def final_status(size: Column, digest: Column, supported: Column, read_error: Column, is_pdf: Column, chars: Column, pages: Column, least: int, ocr: Column, ocr_error: Column, ocr_pages: Column, chunk_count: Column, can_embed: Column) -> Column:
    """The state a processed file ends in; the first rule that holds."""
    thin = is_pdf & (chars / F.greatest(pages, F.lit(1)) < least)
    failed = ocr_error.isNotNull()
    return (
        F.when(F.coalesce(digest, F.lit("")) == "", ERROR)
        .when(size == 0, EMPTY)
        .when(~supported, UNSUPPORTED)
        .when(read_error.isNotNull(), ERROR)
        .when((chars == 0) & ~is_pdf, EMPTY)
        .when((chars == 0) & failed, ERROR)
        .when(chars == 0, NEEDS_OCR)
        .when(thin & failed, ERROR)
        .when(thin & (F.coalesce(ocr_pages, F.lit(0)) == 0), NEEDS_OCR)
        .when(chunk_count == 0, EMPTY)
        .when(~can_embed, PENDING)
        .otherwise(INDEXED)
    )
