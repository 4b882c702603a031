"""The chunk store: immutable snapshots, replaced by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace(old: DataFrame, new: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Chunks of new's sources (or the touched ones) replaced by new; of equal (source, chunk) the last one given stays."""
    gone = touched if touched is not None else new.select("source").distinct()
    by = Window.partitionBy("source", "chunk").orderBy(F.desc("chunk_id"))
    fresh = new.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
    return old.join(gone, "source", "left_anti").select(*old.columns).unionByName(fresh)


def delete(old: DataFrame, sources: DataFrame) -> DataFrame:
    return old.join(sources.select("source"), "source", "left_anti").select(*old.columns)


def relabel(old: DataFrame, moves: DataFrame) -> DataFrame:
    """Moved files' chunks under their new source and root; ids, texts and vectors stay. moves: old_path, path, root."""
    to = moves.select(F.col("old_path").alias("source"), F.col("path").alias("__to"), F.col("root").alias("__root"))
    out = old.join(to, "source", "left")
    return out.withColumns({"source": F.coalesce("__to", "source"), "root": F.coalesce("__root", "root")}).select(*old.columns)


def apply_changes(old: DataFrame, fresh: DataFrame, moves: DataFrame, deleted: DataFrame, replaced: DataFrame) -> DataFrame:
    """The next snapshot in one plan: relabelled, less deleted and replaced sources, and the fresh chunks."""
    gone = deleted.select("source").union(replaced.select("source")).distinct()
    return replace(relabel(delete(old, gone), moves), fresh, replaced.select("source").distinct())
