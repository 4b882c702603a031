"""Listing source folders and reading manifests and ignore lists."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.functions import hashing
from lodestar.operators import scan

MANIFEST_VERSION = 3
MANIFEST = (
    "path string, root string, size bigint, mtime double, content_hash string, signature string, page_count int, has_text_layer boolean, pages_without_text int, chunk_count int, status string, "
    "last_processed string, attempts int, note string, embedding_fingerprint string, ocr_fingerprint string, ocr_pages int, ocr_pdf_hash string, ocr_pdf_fingerprint string"
)


class ManifestVersionError(ValueError):
    """The manifest was written by a newer version."""


#: Up to so many files are read by name; beyond that, by folder and a semi join on their paths.
NAMED_FILES = 10_000
LISTED = "root string, ord int, path string, abs_path string, name string, size bigint, uri string, mtime double"


def _qualified(spark: SparkSession, root: str) -> tuple[str, bool]:
    """The root in the form in which Spark names files (scheme and host, no slash at the end), and whether it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/"), fs.exists(path)


def _names(spark: SparkSession, found: DataFrame) -> DataFrame:
    """uri of every file of a folder, those without bytes too: Spark's file index, which the driver holds for any read."""
    listed = spark.createDataFrame(pa.table({"value": pa.array(found.inputFiles(), pa.string())}))
    encoded = listed.select(F.regexp_replace("value", r"^file:/+", "file:/").alias("value"))
    # the index escapes names, the path column doesn't; a plus sign is no space here
    return encoded.select(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))).alias("uri"))


def listing(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, list[str]]:
    """root, ord, path (below its root), abs_path, name, size, uri, mtime of all files, and the roots that can't be read.

    Only metadata is read: the content column isn't selected. Spark's reader
    passes over files without bytes, its index knows them: they have size 0 and no time.
    """
    out, missing = None, []
    for i, root in enumerate(roots):
        base, there = _qualified(spark, root)
        if not there:
            missing.append(root)
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("__globPaths__", "false").load(base)
        full = found.select(F.col("path").alias("uri"), F.unix_micros("modificationTime").alias("micros"), "length")
        rows = _names(spark, found).join(full, "uri", "left").select(
            F.lit(root).alias("root"),
            F.lit(i).alias("ord"),
            F.substring("uri", F.lit(len(base) + 2), F.char_length("uri")).alias("path"),
            F.regexp_replace("uri", "^[a-z0-9]+:/*", "/").alias("abs_path"),
            F.element_at(F.split("uri", "/"), -1).alias("name"),
            F.coalesce("length", F.lit(0)).cast("long").alias("size"),
            "uri",
            (F.col("micros").cast("double") / 1e6).alias("mtime"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], LISTED), missing


def contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """uri and content of files (uri, root). A file that can't be read has no row, the others do.

    A few files are read by their names; many by their folders with a semi join, so no long list goes through the driver.
    """
    names = [r["uri"] for r in files.select("uri").distinct().limit(NAMED_FILES + 1).collect()]
    # names are names, not patterns: brackets and stars in them stand for themselves
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).option("__globPaths__", "false")
    if not names:
        return spark.createDataFrame([], "uri string, content binary")
    if len(names) > NAMED_FILES:
        roots = [_qualified(spark, r["root"])[0] for r in files.select("root").distinct().collect()]  # configured folders, a few
        found = reader.option("recursiveFileLookup", True).load(roots)
        return found.select(F.col("path").alias("uri"), "content").join(files.select("uri").distinct(), "uri", "left_semi").dropDuplicates(["uri"])
    there = [n for n in names if _qualified(spark, n)[1]]
    return reader.load(there).select(F.col("path").alias("uri"), "content") if there else spark.createDataFrame([], "uri string, content binary")


def with_uri(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """entries (path, root, ...) with the uri under which Spark knows the file."""
    bases = {r["root"]: _qualified(spark, r["root"])[0] for r in entries.select("root").distinct().collect()}  # configured folders, a few
    base = F.lit(None).cast("string")
    for root, known in bases.items():
        base = F.when(F.col("root") == root, F.lit(known)).otherwise(base)
    return entries.withColumn("uri", F.concat(base, F.lit("/"), "path"))


def hashed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows (uri, ...) with content_hash; null for files that can't be read. Reads the content of these files alone."""
    content = contents(spark, rows.where("size > 0")).select("uri", hashing.content_hash(F.col("content")).alias("content_hash"))
    empty = F.when(F.col("size") == 0, hashing.content_hash(F.lit(b"")))  # Spark's readers skip files without bytes
    return rows.join(content, "uri", "left").withColumn("content_hash", F.coalesce("content_hash", empty))


def scan_sources(spark: SparkSession, settings: Settings, previous: DataFrame | None = None, ignored: DataFrame | None = None, full_hash: bool = False) -> tuple[DataFrame, dict, dict[str, DataFrame]]:
    """The entries of all files, the counters of the scan, and what it met: locks, overlap, stale, unreadable.

    A file that can't be read has an entry without a hash: an error that later runs try again.
    """
    found, missing = listing(spark, list(settings.docs_source))
    found = found.cache()
    locks = scan.is_lock_file(F.col("name"), settings.lock_file_patterns)
    wanted = found.where(~locks & F.lower(scan.suffix(F.col("name"))).isin(*settings.file_types))
    single = scan.first_root_wins(wanted)
    kept = scan.without_ignored(single, ignored) if ignored is not None else single
    old = previous if previous is not None else spark.createDataFrame([], MANIFEST)
    marked = scan.unchanged_or_hashed(kept, old, full_hash)
    if "embedding_fingerprint" in marked.columns:
        model = hashing.embedding_fingerprint(F.lit(settings.embedding_model))
        marked = marked.withColumn("embedding_fingerprint", scan.backfilled_fingerprint(F.col("status"), F.col("embedding_fingerprint"), model))
    fresh = hashed(spark, marked.where("NOT carry").drop("content_hash"))
    entries = marked.where("carry").drop("carry").unionByName(fresh.drop("carry"))
    offline = scan.kept_offline(old, entries, spark.createDataFrame([(m,) for m in missing], "root string"))
    met = {
        "locks": found.where(locks).select("path"),
        "overlap": wanted.groupBy("abs_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "stale": scan.stale_ignores(single, ignored) if ignored is not None else spark.createDataFrame([], "path string"),
        "unreadable": entries.where("content_hash IS NULL").select("path"),
    }
    counters = {
        "unreachable": missing,
        "lock_files": met["locks"].count(),
        "overlap": wanted.count() - single.count(),
        "ignored": single.count() - kept.count(),
        "kept_offline": offline.count(),
    }
    columns = [c.split(" ")[0] for c in MANIFEST.split(", ")]
    for frame_name in columns:
        if frame_name not in entries.columns:
            entries = entries.withColumn(frame_name, F.lit(None).cast(old.schema[frame_name].dataType))
    return entries.select(*columns).unionByName(offline.select(*columns)), counters, met


def ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of paths."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("path"))


def manifest_of_json(spark: SparkSession, path: str) -> DataFrame:
    """A manifest document: entries by path under "files", or (older) at the top."""
    body = spark.read.text(path, wholetext=True).first()[0]
    parsed = json.loads(body)
    version = parsed.get("schema_version", 1) if isinstance(parsed.get("files"), dict) else 1
    if version > MANIFEST_VERSION:
        raise ManifestVersionError(f"manifest version {version} is newer than {MANIFEST_VERSION}")
    entries = parsed["files"] if isinstance(parsed.get("files"), dict) else parsed
    lines = [json.dumps({"path": str(PurePosixPath(p)), **e}) for p, e in sorted(entries.items())]
    return spark.createDataFrame([(x,) for x in lines], "j string").select(F.from_json("j", MANIFEST).alias("e")).select("e.*")


def latest_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot that the pointer names; empty if there is none."""
    from lodestar.sources.snapshots import current

    found = current(spark, folder)
    return found if found is not None else spark.createDataFrame([], MANIFEST)
