"""Digests that name content, chunks and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def text_signature(text: Column, size: Column, prefix: int) -> Column:
    """Of size, length, the first and (where the text is longer than that) the last characters."""
    tail = F.when(F.char_length(text) > prefix, F.right(text, F.lit(prefix))).otherwise("")
    return F.substring(F.md5(F.concat_ws("|", size.cast("string"), F.char_length(text).cast("string"), F.left(text, F.lit(prefix)), tail)), 1, 12)


def page_signature(size: Column, page_count: Column, first_page: Column, last_page: Column, prefix: int) -> Column:
    tail = F.when(page_count > 1, F.left(last_page, F.lit(prefix))).otherwise("")
    return F.substring(F.md5(F.concat_ws("|", size.cast("string"), page_count.cast("string"), F.left(first_page, F.lit(prefix)), tail)), 1, 12)


def path_signature(size: Column, path: Column) -> Column:
    """Never equal for different paths: for types without text and unreadable files."""
    return F.substring(F.md5(F.concat_ws("|", size.cast("string"), path)), 1, 12)


def chunk_id(path: Column, digest: Column, number: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", path, digest, number.cast("string"))), 1, 20)


def embedding_fingerprint(model: Column) -> Column:
    return F.substring(F.sha1(model), 1, 12)


def ocr_fingerprint(settings: list[Column], engines: Column) -> Column:
    """Of the settings that decide what OCR reads, and the sorted names of the usable engines."""
    parts = [*[s.cast("string") for s in settings], F.array_join(F.array_sort(engines), "+")]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)
