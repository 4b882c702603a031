"""Pages to chunks, and chunks to rows of the chunk store."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.functions import hashing, text


def chunk_pages(pages: DataFrame, settings: Settings) -> DataFrame:
    """path, page_idx, page, piece, section, text: every page chunked by itself, so a chunk's page is exact.

    The fold depends on its own result, so it runs in Arrow batches where the pages are.
    """
    size, overlap, least = settings.chunk_size, settings.chunk_overlap, settings.min_chunk_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, section, body = [], [], [], []
            for i, (content, label) in enumerate(zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True)):
                for k, (chunk, at) in enumerate(text.chunks(content or "", label, size, overlap, least)):
                    row.append(i)
                    piece.append(k)
                    section.append(at)
                    body.append(chunk)
            take = pa.array(row, pa.int64())
            yield pa.record_batch([batch["path"].take(take), batch["page_idx"].take(take), batch["page"].take(take), pa.array(piece, pa.int32()), pa.array(section, pa.string()), pa.array(body, pa.string())], names=["path", "page_idx", "page", "piece", "section", "text"])

    given = pages.select(F.col("path").cast("string"), F.col("page_idx").cast("int"), F.col("page").cast("int"), F.col("label").cast("string"), F.col("text").cast("string"))
    return given.mapInArrow(run, "path string, page_idx int, page int, piece int, section string, text string")


def numbered(chunks: DataFrame) -> DataFrame:
    """chunk (0-based over the file, in page order) and chunk_total."""
    by = Window.partitionBy("path")
    return chunks.withColumn("chunk", F.row_number().over(by.orderBy("page_idx", "piece")) - 1).withColumn("chunk_total", F.count(F.lit(1)).over(by).cast("int"))


def store_rows(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the chunk store without vectors: no page is -1, no section '', the type is the lower-case suffix."""
    kind = F.lower(F.regexp_extract("path", r"^.+\.([^./]+)$", 1))
    out = numbered(chunks).join(files.select("path", "root", "content_hash"), "path")
    return out.select(
        hashing.chunk_id(F.col("path"), F.col("content_hash"), F.col("chunk")).alias("chunk_id"),
        F.col("path").alias("source"),
        "root",
        "chunk",
        "chunk_total",
        F.coalesce("page", F.lit(-1)).alias("page"),
        F.coalesce("section", F.lit("")).alias("section"),
        kind.alias("file_type"),
        "content_hash",
        "text",
    )


def line_blocks(docs: DataFrame) -> DataFrame:
    """path, block, heading, body of every text, relationally: lines, a running count of headings, and their lines together."""
    lines = docs.select("path", F.posexplode(F.split(text.unix_newlines(F.coalesce("text", F.lit(""))), "\n")).alias("i", "line"))
    lines = lines.withColumn("head", text.is_heading(F.col("line")))
    order = Window.partitionBy("path").orderBy("i")
    marked = lines.withColumn("block", F.sum(F.col("head").cast("int")).over(order))
    joined = marked.groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("i", "line", "head"))).alias("ls"))
    body = text.ustrip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    heading = F.when(F.element_at("ls", 1)["head"], F.substring(text.ustrip(F.element_at("ls", 1)["line"]), 1, text.HEADING_CHARS))
    return joined.select("path", "block", heading.alias("heading"), body.alias("body")).where("body <> ''")


def rendered_rows(table: DataFrame, key: str, columns: list[str], most: int) -> DataFrame:
    """n, line: the first ``most`` rows (by key) that aren't blank, each as one line. ``most`` is the feature."""
    lines = table.select(key, text.rendered_row([F.col(c) for c in columns]).alias("line")).where("line <> ''")
    return lines.orderBy(key).limit(most)
