"""Which pages go to OCR and what becomes of the answers. Engines themselves are plugged in."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import stripped_length


class Engine(Protocol):
    name: str

    def available(self) -> bool: ...

    def ocr_image(self, image: bytes) -> str: ...


def engines_for(backend: str, local: Engine, api: Engine) -> list[Engine]:
    """Engines of a backend, in order; an unknown one counts as hybrid."""
    if str(backend).lower() in ("none", "off", "false", "no", ""):
        return []
    return {"local": [local], "tesseract": [local], "api": [api]}.get(str(backend).lower(), [local, api])


def api_text(reply: dict) -> str:
    """The text of a chat reply, whose content is a string or a list of parts."""
    try:
        content = reply["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError):
        return ""
    if isinstance(content, list):
        return "".join(p.get("text", "") for p in content if isinstance(p, dict))
    return content if isinstance(content, str) else ""


def needs_ocr(text: Column, least: int) -> Column:
    return stripped_length(text) < least


def text_layers(pages: DataFrame, least: int, blank: int) -> DataFrame:
    """path, n_pages, chars, has_text_layer (mean characters a page), blank_pages."""
    n = stripped_length(F.col("text"))
    return pages.groupBy("path").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(n).alias("chars"), (F.sum(n) / F.count(F.lit(1)) >= least).alias("has_text_layer"), F.count_if(n < blank).alias("blank_pages"))


def numbered_candidates(pages: DataFrame, least: int) -> DataFrame:
    """Numbered pages with too little text, counted within their file by ``nth``."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy("page"))
    return pages.where(F.col("page").isNotNull() & needs_ocr(F.coalesce("text", F.lit("")), least)).withColumn("nth", nth)


def candidates(pages: DataFrame, least: int, per_file: int) -> DataFrame:
    """The first per_file of numbered_candidates."""
    return numbered_candidates(pages, least).where(F.col("nth") <= per_file)


def admitted(wanted: DataFrame, budget: int) -> DataFrame:
    """wanted (path, page, ...) with ``admitted``: the first ``budget`` of them by path and page.

    The budget is the feature: a distributed top-n, never a window over all pages.
    """
    first = wanted.select("path", "page").orderBy("path", "page").limit(budget).withColumn("admitted", F.lit(True))
    return wanted.join(first, ["path", "page"], "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def chosen_text(primary: Column, primary_failed: Column, escalation: Column, escalation_ok: Column, below: int) -> tuple[Column, Column, Column]:
    """escalated, text, failed of a page read by a first and perhaps a second engine.

    escalation_ok: null if there is no second engine, false if it failed.
    """
    first = F.when(primary_failed, F.lit("")).otherwise(F.coalesce(primary, F.lit("")))
    asked = escalation_ok.isNotNull() & (primary_failed | (stripped_length(first) < below))
    saved = asked & F.coalesce(escalation_ok, F.lit(False))
    longer = saved & (stripped_length(escalation) > stripped_length(first))
    return asked, F.when(longer, escalation).otherwise(first), primary_failed & ~saved


def settled(attempted: Column, incomplete: Column, errors: Column, fatal: Column) -> Column:
    return attempted & ~incomplete & (errors == 0) & fatal.isNull()


def cached(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """pages with cached_text where hash, settings and page number all agree."""
    hits = cache.select("path", "content_hash", "fingerprint", "page", F.col("text").alias("cached_text"))
    return pages.join(hits, ["path", "content_hash", "fingerprint", "page"], "left")


def run_cost(pages: DataFrame, price: float) -> DataFrame:
    """One row: pages read, pages by the second engine and their estimated price."""
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if("escalated").alias("api_pages"), F.round(F.count_if("escalated") * price, 4).alias("est_cost"))
