"""Rules of a file scan, over a listing (root, ord, path, abs_path, name, size, mtime)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of the previous entry that an unchanged file keeps.
CARRIED = ("content_hash", "signature", "page_count", "has_text_layer", "pages_without_text", "chunk_count", "status", "last_processed", "attempts", "note", "embedding_fingerprint", "ocr_fingerprint", "ocr_pages", "ocr_pdf_hash", "ocr_pdf_fingerprint")


def glob_regex(pattern: str) -> str:
    """A shell pattern (* ? [seq] [!seq]) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def is_lock_file(name: Column, patterns: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for p in patterns:
        test = test | name.rlike(glob_regex(p))
    return test


def suffix(name: Column) -> Column:
    """The last dot and what follows, '' for names without one or that begin with their only dot."""
    return F.regexp_extract(name, r"^.+(\.[^./]+)$", 1)


def extension_histogram(names: DataFrame, blank: str = "(none)") -> DataFrame:
    """ext, n over lower-cased suffixes."""
    return names.groupBy(F.lower(suffix(F.col("name"))).alias("e")).agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("e") == "", blank).otherwise(F.col("e")).alias("ext"), "n")


def first_root_wins(listing: DataFrame) -> DataFrame:
    """One row for each absolute path: that of the first root. The minimum is aggregated before the shuffle."""
    rest = [c for c in listing.columns if c != "abs_path"]
    return listing.groupBy("abs_path").agg(F.min(F.struct("ord", *[c for c in rest if c != "ord"])).alias("first")).select("abs_path", *[F.col(f"first.{c}").alias(c) for c in rest])


def without_ignored(listing: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files whose relative and absolute paths aren't on the list. Backslashes of the list count as slashes."""
    marks = ignored.select(F.translate("path", "\\", "/").alias("mark")).distinct()
    left = listing.join(marks, listing["path"] == marks["mark"], "left_anti")
    return left.join(marks, left["abs_path"] == marks["mark"], "left_anti")


def stale_ignores(listing: DataFrame, ignored: DataFrame) -> DataFrame:
    """Marks that match no file."""
    marks = ignored.select(F.translate("path", "\\", "/").alias("mark")).distinct()
    there = listing.select(F.explode(F.array("path", "abs_path")).alias("mark")).distinct()
    return marks.join(there, "mark", "left_anti").select(F.col("mark").alias("path"))


def nested_roots(roots: DataFrame) -> DataFrame:
    """inner, outer: roots below other roots. By equality on the ancestors of each root, so no pairs are tried."""
    parts = F.split("root", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = roots.select(F.col("root").alias("inner"), F.explode(ups).alias("outer")).where("inner <> outer")
    return above.join(roots.select(F.col("root").alias("outer")), "outer").select("inner", "outer").distinct()


def unchanged_or_hashed(listing: DataFrame, previous: DataFrame, full_hash: bool = False) -> DataFrame:
    """The listing with the previous entry's fields and ``carry``: same size and time, so no new hash is needed."""
    fields = [c for c in CARRIED if c in previous.columns]
    old = previous.select("path", F.col("size").alias("p_size"), F.col("mtime").alias("p_mtime"), *fields)
    same = (F.col("size") == F.col("p_size")) & (F.col("mtime") == F.col("p_mtime")) & F.lit(not full_hash)
    return listing.join(old, "path", "left").withColumn("carry", F.coalesce(same, F.lit(False))).drop("p_size", "p_mtime")


def backfilled_fingerprint(status: Column, stored: Column, model_print: Column) -> Column:
    return F.when(status == "indexed", F.coalesce(F.nullif(stored, F.lit("")), model_print)).otherwise(stored)


def kept_offline(previous: DataFrame, current: DataFrame, unreachable: DataFrame) -> DataFrame:
    """Previous entries of roots that can't be read, as they are."""
    return previous.join(unreachable.select("root"), "root", "left_semi").join(current.select("path"), "path", "left_anti")
