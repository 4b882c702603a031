"""Command line: `python -m lodestar.cli ingest|ask|dedup|extensions ...`."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.config import Settings, load


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestar")
    top.add_argument("--config", default=None)
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("ingest")
    run.add_argument("--source", action="append")
    run.add_argument("--manifest", required=True)
    run.add_argument("--collection", required=True)
    run.add_argument("--ignore-list")
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--audit", action="store_true")
    run.add_argument("--full-hash", action="store_true")
    run.add_argument("--strict", action="store_true")
    run.add_argument("--no-ocr", action="store_true")
    run.add_argument("--ocr-limit", type=int)
    ask = sub.add_parser("ask")
    ask.add_argument("question", nargs="?")
    ask.add_argument("--collection", required=True)
    ask.add_argument("--interactive", action="store_true")
    ask.add_argument("--top-k", type=int)
    ask.add_argument("--min-score", type=float)
    ask.add_argument("--contains")
    ask.add_argument("--show-context", action="store_true")
    ask.add_argument("--json", action="store_true")
    ask.add_argument("--llm", help="a backend of the settings, or none")
    dup = sub.add_parser("dedup")
    dup.add_argument("--source", action="append")
    dup.add_argument("--output", required=True)
    ext = sub.add_parser("extensions")
    ext.add_argument("--source", action="append")
    return top


def _ask(spark: SparkSession, args, settings: Settings) -> int:
    from lodestar.functions.embedding import hashing_encoder
    from lodestar.plans.question import answer_question
    from lodestar.sources import engines, snapshots

    model, doubt = engines.select_model(settings.other, args.llm)
    if doubt:
        print(f"warning: {doubt}", file=sys.stderr)
    chunks = snapshots.current(spark, args.collection)
    if chunks is None or chunks.isEmpty():
        print("the collection is missing or empty", file=sys.stderr)
        return 1
    code = 0
    for question in (line.strip() for line in sys.stdin) if args.interactive else [args.question or ""]:
        if args.interactive and question in ("", "exit", "quit"):
            break
        probe = hashing_encoder()([question])[0].tolist() if question.strip() else None
        found = answer_question(chunks, question, probe, settings, model, args.top_k, args.min_score, args.contains)
        print(found.as_json() if args.json else found.as_text(args.show_context))
        for w in found.warnings:
            print(f"warning: {w}", file=sys.stderr)
        code = found.exit_code
    return code


def _recognition(settings: Settings, limit: int | None):
    """The engines of the settings that can be used here; None if OCR is off."""
    from lodestar.operators.ocr import engines_for
    from lodestar.plans.recognise import Recognition, usable
    from lodestar.sources import engines

    local, api = engines.LocalOcr(settings.ocr_languages), engines.ApiOcr(settings.ocr_api_url, settings.ocr_api_model, settings.other.get("ocr_api_key_env", ""))
    wanted = engines_for(settings.ocr_backend, local, api)
    return Recognition(usable(wanted), engines.PdfRenderer(settings.ocr_dpi), settings, limit, settings.other.get("ocr_cache_path")) if wanted else None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    settings = load(args.config) if args.config else Settings()
    if getattr(args, "source", None):
        settings = dataclasses.replace(settings, docs_source=tuple(args.source))
    spark = spark or SparkSession.builder.appName("lodestar").getOrCreate()
    if args.command == "ask":
        return _ask(spark, args, settings)
    from lodestar.operators import dedup, scan
    from lodestar.plans import ingest
    from lodestar.sources import files

    if args.command == "ingest":
        ignored = files.ignore_list(spark, args.ignore_list) if args.ignore_list else None
        try:
            dry = args.dry_run or args.audit
            ocr = None if dry or args.no_ocr else _recognition(settings, args.ocr_limit)
            run = ingest.ingest(spark, settings, args.manifest, args.collection, ignored, dry, args.full_hash, args.strict, ocr=ocr, sources_overridden=bool(args.source))
        except files.ManifestVersionError as e:
            print(e, file=sys.stderr)
            return 1
        print(json.dumps(dataclasses.asdict(run), ensure_ascii=False, indent=1))
        return run.exit_code
    listing, missing = files.listing(spark, list(settings.docs_source))
    for m in missing:
        print(f"warning: {m} can't be read", file=sys.stderr)
    if args.command == "extensions":
        for r in scan.extension_histogram(listing).orderBy(F.desc("n"), "ext").toLocalIterator():
            print(f"{r['n']:>8}  {r['ext']}")
        return 0
    from lodestar.sources import readers

    wanted = listing.where(F.lower(scan.suffix(F.col("name"))).isin(".txt", ".md", ".docx", ".pdf")).dropDuplicates(["path"])
    content = files.contents(spark, wanted).join(wanted.select("uri", F.col("path").alias("name")), "uri").select(F.col("name").alias("path"), "content")
    signed = dedup.file_signatures(wanted, readers.extract_pages(content), settings.signature_prefix_chars)
    lost = dedup.ignore_list(signed).orderBy("path")
    with open(args.output, "w", encoding="utf-8") as out:
        json.dump([r["path"] for r in lost.toLocalIterator()], out, ensure_ascii=False, indent=1)
    return 0


if __name__ == "__main__":
    sys.exit(main())
