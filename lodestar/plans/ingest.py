"""One ingestion run: scan, classify, extract, chunk, embed, and commit both tables.

The run is a diff of two snapshots. Only new and modified files are read. The
chunk store and the manifest are each committed by one pointer, the store first,
so a run that dies in between is repeated without harm: chunks are replaced by
their source.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.functions import embedding, hashing, text
from lodestar.operators import changes, chunking, dedup, reports, scan, store
from lodestar.operators import ocr as ocr_ops
from lodestar.plans import recognise
from lodestar.sources import files as sources
from lodestar.sources import readers, snapshots

STORE = "chunk_id string, source string, root string, chunk int, chunk_total int, page int, section string, file_type string, content_hash string, text string, embedding array<float>, ingested_at string"


@dataclass
class Run:
    changes: dict[str, int]
    statuses: dict[str, int]
    scan: dict
    exit_code: int = 0
    warnings: list[str] = field(default_factory=list)


def read_pages(spark: SparkSession, entries: DataFrame, settings: Settings) -> DataFrame:
    """Pages of entries (path, root). Files that can't be read have none."""
    wanted = sources.with_uri(spark, entries.select("path", "root"))
    content = sources.contents(spark, wanted).join(wanted.select("uri", "path"), "uri")
    return readers.extract_pages(content.select("path", "content"), settings.spreadsheet_max_rows)


def processed(entries: DataFrame, pages: DataFrame, chunks: DataFrame, settings: Settings, can_embed: bool = True, ocr: DataFrame | None = None, ocr_print: str | None = None) -> DataFrame:
    """entries with the state that processing ends in. ocr: what the pass says of each file, if there was one."""
    n = text.stripped_length(F.coalesce("text", F.lit("")))
    per = pages.groupBy("path").agg(
        F.coalesce(F.sum(F.when(F.col("page_idx").isNotNull(), n)), F.lit(0)).alias("chars"),
        F.count("page_idx").alias("pages"),
        F.count_if(F.col("page_idx").isNotNull() & (n < settings.blank_page_chars)).alias("blank"),
        F.bool_and("supported").alias("supported"),
        F.first("note", ignorenulls=True).alias("read_note"),
    )
    counts = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("made"))
    blank_pass = "path string, attempted boolean, incomplete boolean, errors long, fatal string, ocr_pages long, recovered long, ocr_note string"
    passed = (ocr if ocr is not None else entries.sparkSession.createDataFrame([], blank_pass)).withColumnRenamed("ocr_pages", "new_ocr_pages")
    joined = entries.join(per, "path", "left").join(counts, "path", "left").join(passed, "path", "left")
    error = F.when(F.col("supported") & F.col("read_note").startswith("error: "), F.col("read_note"))
    is_pdf = F.lower("path").endswith(".pdf")
    errors = F.coalesce("errors", F.lit(0))
    ocr_error = F.coalesce("fatal", F.when((errors > 0) & (F.coalesce("recovered", F.lit(0)) == 0), F.coalesce("ocr_note", F.lit("OCR failed on every page"))))
    missing = (F.col("size") > 0) & F.col("pages").isNull() & F.col("content_hash").isNotNull()  # it went between the scan and the reading
    status = changes.final_status(
        F.col("size"), F.col("content_hash"), F.coalesce("supported", F.lit(False)) | missing, F.when(missing, "error: the file went away").otherwise(error), is_pdf, F.coalesce("chars", F.lit(0)),
        F.coalesce("pages", F.lit(0)), settings.ocr_min_chars_per_page, F.lit(ocr is not None), ocr_error, F.coalesce("recovered", F.lit(0)), F.coalesce("made", F.lit(0)), F.lit(can_embed),
    )
    out = joined.withColumn("new_status", status)
    done = F.col("new_status").isin(changes.INDEXED, changes.PENDING)
    settled = ocr_ops.settled(F.coalesce("attempted", F.lit(False)), F.coalesce("incomplete", F.lit(False)), errors, F.col("fatal"))
    waits = F.lit("no text layer - OCR found none") if ocr is not None else F.lit("no text layer - OCR not available")
    note = (
        F.when(F.coalesce("content_hash", F.lit("")) == "", "unreadable")
        .when(missing, "error: the file went away")
        .when(F.col("size") == 0, "zero-byte file")
        .when(F.col("new_status") == changes.NEEDS_OCR, text.combined_notes(waits, F.col("ocr_note")))
        .when(F.col("new_status") == changes.EMPTY, "no extractable text")
        .otherwise(text.combined_notes(F.col("read_note"), F.col("ocr_note")))
    )
    return out.withColumns({
        "attempts": changes.attempts_after(F.col("new_status"), F.col("attempts")),
        "page_count": F.when(done, F.col("pages").cast("int")),
        "has_text_layer": F.when(done, F.lit(True)),
        "pages_without_text": F.when(done, F.col("blank").cast("int")),
        "chunk_count": F.when(done, F.col("made").cast("int")).otherwise(0),
        "embedding_fingerprint": F.when(F.col("new_status") == changes.INDEXED, hashing.embedding_fingerprint(F.lit(settings.embedding_model))).otherwise(F.col("embedding_fingerprint")),
        "ocr_fingerprint": F.when(settled, F.lit(ocr_print)).otherwise(F.col("ocr_fingerprint")),
        "ocr_pages": F.when(F.coalesce("new_ocr_pages", F.lit(0)) > 0, F.col("new_ocr_pages").cast("int")).otherwise(F.col("ocr_pages")),
        "note": note,
        "last_processed": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "status": F.col("new_status"),
    }).select(*entries.columns)


def ingest(
    spark: SparkSession, settings: Settings, manifest: str, collection: str, ignored: DataFrame | None = None, dry_run: bool = False, full_hash: bool = False, strict: bool = False,
    load_model=embedding.hashing_encoder, ocr: recognise.Recognition | None = None, sources_overridden: bool = False,
) -> Run:
    """One run over settings.docs_source. dry_run: plans and reports, reads no texts, asks no engine and writes nothing."""
    previous = sources.latest_manifest(spark, manifest)
    current, counters, met = sources.scan_sources(spark, settings, previous, ignored, full_hash)
    current = current.cache()
    engines = ocr if ocr is not None and ocr.available() and not dry_run else None
    mark = engines.fingerprint(spark) if engines else None
    model = hashing.embedding_fingerprint(F.lit(settings.embedding_model))
    why = changes.reprocess_reason(F.col("p_status"), F.col("p_attempts"), F.col("path"), F.col("p_pages_without_text"), F.col("p_ocr_fingerprint"), F.col("p_embedding_fingerprint"), F.lit(settings.max_retries), F.lit(mark).cast("string"), model, F.lit(True))
    found = changes.rewrite_unindexed_moves(changes.classify(current, previous, why, settings.track_moves, settings.track_deletions), previous).cache()
    tally = {r["type"]: r["n"] for r in changes.change_counts(found).collect()}
    if dry_run:
        return Run(tally, {}, counters, warnings=_warnings(spark, settings, counters, met, current, found, previous, sources_overridden))
    work = current.join(found.where(F.col("type").isin(changes.NEW, changes.MODIFIED)).select("path"), "path", "left_semi")
    extracted = read_pages(spark, work.where("size > 0 AND content_hash IS NOT NULL"), settings).cache()
    signed = work.drop("signature").join(dedup.file_signatures(work, extracted, settings.signature_prefix_chars), "path", "left").select(*work.columns)
    pages, passed = recognise.filled(spark, signed, extracted, engines) if engines else (extracted, None)
    pages = pages.cache()
    chunks = chunking.chunk_pages(pages.where("page_idx IS NOT NULL"), settings)
    outcome = processed(signed, pages, chunks, settings, ocr=passed, ocr_print=mark).cache()
    good = outcome.where(F.col("status") == changes.INDEXED)
    fresh = chunking.store_rows(chunks.join(good.select("path"), "path", "left_semi"), good).withColumns({"embedding": embedding.embedded(F.col("text"), load_model, settings.embedding_batch_size), "ingested_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")})
    moves = found.where(F.col("type") == changes.MOVED).select("path", "old_path").join(current.select("path", "root"), "path")
    deleted = found.where(F.col("type") == changes.DELETED).select(F.col("path").alias("source"))
    old = snapshots.open_or_create(spark, collection, STORE)
    replaced = work.select(F.col("path").alias("source"))
    snapshots.commit(store.apply_changes(old, fresh.select(*old.columns), moves, deleted, replaced), collection)
    fields = [c for c in previous.columns if c not in ("path", "root", "size", "mtime", "content_hash")]
    same = current.join(found.where(F.col("type") == changes.UNCHANGED).where("NOT keep").select("path"), "path", "left_semi")
    kept = previous.join(found.where("keep").select("path"), "path", "left_semi")
    moved_now = current.join(moves.select("path", "old_path"), "path")
    moved = changes.carried(moved_now.select("path", "old_path", *fields), previous, fields).drop("old_path").join(current.drop(*fields), "path")
    entries = same.unionByName(kept).unionByName(moved.select(*same.columns)).unionByName(outcome.select(*same.columns))
    snapshots.commit(entries, manifest)
    after = sources.latest_manifest(spark, manifest)
    statuses = {r["status"]: r["n"] for r in reports.outcome_counts(after).collect()}
    noted = _warnings(spark, settings, counters, met, after, found, previous, sources_overridden)
    counters["ocr"] = dict(engines.counters) if engines else {}
    for df in (current, found, extracted, pages, outcome):
        df.unpersist()
    code = reports.strict_blocked(after).first()["exit_code"] if strict else 0
    return Run(tally, statuses, counters, code, noted + recognise.report(ocr, ocr is not None and not dry_run))


def _warnings(spark: SparkSession, settings: Settings, counters: dict, met: dict[str, DataFrame], entries: DataFrame, found: DataFrame, previous: DataFrame, sources_overridden: bool) -> list[str]:
    """What a run should mention, a sentence each. Stale ignores say nothing where other sources than the configured ones were scanned."""
    stale = met["stale"].where(F.lit(not sources_overridden))
    signatures = entries.select("path", "signature").unionByName(previous.select("path", "signature")).dropDuplicates(["path"])
    others = reports.warnings(met["overlap"], met["locks"], dedup.duplicate_groups(entries), stale, reports.mixed_files(entries))
    roots = spark.createDataFrame([(r.rstrip("/"),) for r in settings.docs_source], "root string")
    unreachable = spark.createDataFrame([(r,) for r in counters["unreachable"]], "root string")
    rows = reports.run_warnings(unreachable, counters["kept_offline"], scan.nested_roots(roots), met["unreadable"], changes.rename_hints(found.select("path", "type"), signatures), others)
    return [r["message"] for r in rows.orderBy("code", "message").collect()]  # a row for each kind, and for each configured folder


def audit(spark: SparkSession, manifest: str) -> DataFrame:
    return reports.audit_totals(sources.latest_manifest(spark, manifest))
