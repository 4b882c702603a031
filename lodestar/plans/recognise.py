"""The OCR pass of a run as one plan: candidates, cache, budget, engines, and what settles a file.

A page is read where its file's bytes are, on the executors; a file is opened
once. Answers are kept in a versioned table by path, content hash, settings and
page, so a page is paid for once; an empty answer is kept too, a failure never.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.functions import hashing
from lodestar.functions.text import combined_notes, stripped_length
from lodestar.operators import ocr
from lodestar.sources import files, snapshots

CACHE = "path string, content_hash string, fingerprint string, page int, text string"
_READ = "path string, page int, rendered boolean, fatal string, first string, first_failed boolean, second string, second_ok boolean, notes string"


@dataclass
class Recognition:
    """The engines of a run (a first one and perhaps one for hard pages), its renderer, its limit and its cache folder."""

    engines: list
    renderer: object
    settings: Settings
    limit: int | None = None
    cache: str | None = None
    api_names: tuple[str, ...] = ("api",)
    counters: dict = field(default_factory=dict)

    def available(self) -> bool:
        return bool(self.engines)

    def fingerprint(self, spark: SparkSession) -> str:
        of = [F.lit(x) for x in (self.settings.ocr_languages, self.settings.ocr_dpi, self.settings.ocr_min_chars_per_page, self.settings.ocr_escalate_below_chars)]
        return spark.range(1).select(hashing.ocr_fingerprint(of, F.array(*[F.lit(e.name) for e in self.engines]))).first()[0]


def usable(engines: list) -> list:
    """The engines that can be used here, in order."""
    return [e for e in engines if e.available()]


def planned(pages: DataFrame, cache: DataFrame, settings: Settings, limit: int | None) -> DataFrame:
    """Candidate pages (path, content_hash, fingerprint, page, text, ...) with cached_text and plan: capped, cached, read or deferred.

    The limit is the feature: it bounds what a run may spend, over all files in order of path and page.
    """
    wanted = ocr.cached(ocr.numbered_candidates(pages, settings.ocr_min_chars_per_page), cache)
    kind = F.when(F.col("nth") > settings.ocr_max_pages_per_file, "capped").when(F.col("cached_text").isNotNull(), "cached").otherwise("read")
    marked = wanted.withColumn("plan", kind)
    if limit is None:
        return marked
    allowed = ocr.admitted(marked.where("plan = 'read'").select("path", "page"), limit)
    return marked.join(allowed, ["path", "page"], "left").withColumn("plan", F.when((F.col("plan") == "read") & ~F.col("admitted"), "deferred").otherwise(F.col("plan"))).drop("admitted")


def read_pages(work: DataFrame, engines: list, renderer, below: int) -> DataFrame:
    """work (path, content, numbers) to what the engines say of each page. A file is opened once; a fault is that page's or that file's note."""

    def attempt(engine, image: bytes) -> tuple[str | None, str | None]:
        try:
            return engine.ocr_image(image) or "", None
        except Exception as e:  # an engine's fault is the page's
            return None, f"{engine.name}: {type(e).__name__}: {e}"

    def one(path: str, content: bytes, numbers: list[int]) -> Iterator[tuple]:
        try:
            opened = renderer.open(content)
        except Exception as e:
            yield from ((path, n, False, f"cannot open for OCR: {type(e).__name__}: {e}", None, None, None, None, None) for n in numbers)
            return
        for n in numbers:
            try:
                image = renderer.render(opened, n)
            except Exception:  # the page is left out and counted
                image = None
            if image is None:
                yield path, n, False, None, None, None, None, None, None
                continue
            first, note = attempt(engines[0], image)
            second = ok = None
            notes = [note] if note else []
            if len(engines) > 1 and (first is None or len(first.strip()) < below):
                second, note = attempt(engines[1], image)
                ok = second is not None
                notes += [note] if note else []
            yield path, n, True, None, first, first is None, second, ok, "; ".join(notes) or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.string())
        names = [c.split(" ")[0] for c in _READ.split(", ")]
        for batch in batches:
            for path, content, numbers in zip(*[batch[c].to_pylist() for c in ("path", "content", "numbers")], strict=True):
                rows = list(one(path, content or b"", sorted(numbers)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return work.select("path", "content", "numbers").mapInArrow(run, _READ)


def filled(spark: SparkSession, entries: DataFrame, pages: DataFrame, how: Recognition) -> tuple[DataFrame, DataFrame]:
    """pages with the texts that OCR has, and per file: attempted, incomplete, errors, fatal, ocr_pages, recovered, ocr_note.

    entries: path, root, content_hash. Only numbered pages of PDF files take part. The cache and the counters of ``how`` are brought up to date.
    """
    settings, mark = how.settings, how.fingerprint(spark)
    cache = snapshots.current(spark, how.cache) if how.cache else None
    cache = cache if cache is not None else spark.createDataFrame([], CACHE)
    own = pages.where(F.lower("path").endswith(".pdf")).join(entries.select("path", "content_hash"), "path").withColumn("fingerprint", F.lit(mark))
    wanted = planned(own, cache, settings, how.limit).select("path", "content_hash", "fingerprint", "page", "cached_text", "plan").cache()
    numbers = wanted.where("plan = 'read'").groupBy("path").agg(F.collect_list("page").alias("numbers"))  # at most the cap of a file
    located = files.with_uri(spark, entries.join(numbers, "path").select("path", "root", "numbers"))
    work = files.contents(spark, located).join(located, "uri")
    said = read_pages(work, how.engines, how.renderer, settings.ocr_escalate_below_chars)
    escalated, text, failed = ocr.chosen_text(F.col("first"), F.col("first_failed"), F.col("second"), F.col("second_ok"), settings.ocr_escalate_below_chars)
    read = said.withColumns({"escalated": F.col("rendered") & escalated, "new_text": F.when(F.col("rendered"), text), "failed": F.col("rendered") & F.coalesce(failed, F.lit(False))}).cache()
    got = wanted.join(read, ["path", "page"], "left")
    answer = F.when(F.col("plan") == "cached", F.col("cached_text")).when(F.col("rendered") & ~F.col("failed"), F.col("new_text"))
    got = got.withColumn("answer", answer).cache()
    has_text = stripped_length(F.col("answer")) > 0
    new = (F.col("plan") == "read") & F.col("rendered")
    fatal = F.when(F.col("plan") == "read", F.coalesce("fatal", F.when(F.col("rendered").isNull(), F.lit("cannot open for OCR: unreadable"))))
    late, lost, bad, blank = F.col("plan").isin("capped", "deferred"), new.isNull() | ((F.col("plan") == "read") & ~F.col("rendered")), F.coalesce(F.col("failed"), F.lit(False)), new & ~F.col("failed") & ~has_text

    def told(n, words: str):
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {words}")))

    per = got.groupBy("path").agg(
        F.lit(True).alias("attempted"),
        F.bool_or(late).alias("incomplete"),
        F.count_if(bad).alias("errors"),
        F.max(fatal).alias("fatal"),
        F.count_if(new & has_text).alias("ocr_pages"),
        F.count_if(has_text).alias("recovered"),
        F.count_if(F.col("plan") == "capped").alias("capped"),
        F.count_if(blank).alias("blank"),
        F.count_if(lost & F.col("fatal").isNull()).alias("unrendered"),
        F.array_join(F.array_sort(F.collect_set("notes")), "; ").alias("notes"),
    )
    note = combined_notes(
        told(F.col("capped"), "page(s) beyond the cap of a file follow next run"), F.col("fatal"), F.col("notes"), told(F.col("blank"), "page(s) still without text after OCR"),
        told(F.col("errors"), "page(s) failed OCR"), F.when(F.col("fatal").isNull(), told(F.col("unrendered"), "page(s) could not be rendered")),
    )
    per = per.withColumn("ocr_note", note).select("path", "attempted", "incomplete", "errors", "fatal", "ocr_pages", "recovered", "ocr_note")
    second = len(how.engines) > 1
    api = [F.lit(e.name in how.api_names) for e in how.engines] + [F.lit(False)]
    count = got.agg(
        F.count_if(new & has_text).alias("pages_ocred"),
        F.count_if(new).alias("pages_attempted"),
        F.count_if(bad).alias("failures"),
        F.count_if(F.col("plan") == "cached").alias("cache_hits"),
        (F.count_if(new) + F.count_if(F.col("escalated"))).alias("engine_calls"),
        F.count_if(F.col("escalated")).alias("escalations"),
        (F.count_if(new & api[0]) + F.count_if(F.col("escalated") & (api[1] if second else F.lit(False)))).alias("api_pages"),
        F.count_if((F.col("plan") == "read") & ~F.coalesce(F.col("rendered"), F.lit(False))).alias("render_errors"),
        F.count_if(late).alias("deferred"),
    ).first()
    how.counters |= {k: int(v or 0) for k, v in count.asDict().items()}
    how.counters["est_cost"] = round(how.counters["api_pages"] * settings.ocr_api_price, 4)
    if how.cache and how.counters["pages_attempted"]:
        fresh = got.where((F.col("plan") == "read") & F.col("answer").isNotNull()).select("path", "content_hash", "fingerprint", "page", F.col("answer").alias("text"))
        snapshots.commit(merged_cache(cache, fresh), how.cache)
    texts = got.where(has_text).select("path", "page", "answer")
    out = pages.join(texts, ["path", "page"], "left").withColumn("text", F.coalesce("answer", "text")).drop("answer")
    return out.select(*pages.columns), per


def merged_cache(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache after a run. A path whose content or settings have changed loses what was kept of it."""
    now = fresh.select("path", F.col("content_hash").alias("h"), F.col("fingerprint").alias("f")).distinct()
    same = (F.col("h").isNull()) | ((F.col("content_hash") == F.col("h")) & (F.col("fingerprint") == F.col("f")))
    kept = old.join(now, "path", "left").where(same).drop("h", "f").join(fresh.select("path", "page"), ["path", "page"], "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def report(how: Recognition | None, asked: bool) -> list[str]:
    """What the pass did, in sentences; why it didn't run if it was asked for."""
    if how is None or not how.available():
        return ["OCR is configured but no engine is available; scanned pages stay needs_ocr"] if asked else []
    c = how.counters
    lines = [f"OCR read {c.get('pages_ocred', 0)} page(s) with {c.get('engine_calls', 0)} engine call(s), {c.get('cache_hits', 0)} cache hit(s), {c.get('escalations', 0)} escalated"]
    if c.get("api_pages"):
        lines.append(f"{c['api_pages']} page(s) by the API, about ${c['est_cost']:.4f}")
    lines += [f"{c[k]} page(s) {words}" for k, words in (("failures", "failed OCR and will be retried"), ("deferred", "deferred to a later run"), ("render_errors", "could not be rendered")) if c.get(k)]
    return lines
