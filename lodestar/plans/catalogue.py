"""The catalogue of registered queries over the shared tables, each with the same result in SQL.

Documents stand for files: path is source/doc_id.txt, size the bytes of the text.
Earlier snapshots, states and the like are derived from the ids by remainders.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.functions import hashing, text, vectors
from lodestar.operators import changes, chunking, dedup, hybrid, ocr, reports, retrieval, scan, store
from lodestar.plans import recognise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DEFAULTS = Settings()

#: Shared beginnings of the SQL.
_FILES = """WITH files AS (SELECT doc_id, source || '/' || doc_id::VARCHAR || '.txt' AS path, source AS root, text, strlen(text) AS size, left(sha256(text), 16) AS content_hash FROM documents)"""
_SIGNED = f"""{_FILES}, signed AS (SELECT *, left(md5(concat_ws('|', size::VARCHAR, length(text)::VARCHAR, left(text, 300), CASE WHEN length(text) > 300 THEN right(text, 300) ELSE '' END)), 12) AS signature FROM files)"""
_STATES = f"""{_FILES}, states AS (SELECT *, ['indexed', 'needs_ocr', 'pending_embedding', 'unsupported', 'empty', 'error', 'indexed', 'indexed'][(doc_id % 8 + 1)::INT] AS status, (doc_id % 5)::INT AS attempts, (doc_id % 7)::INT AS chunk_count, (doc_id % 11 + 1)::INT AS page_count, (doc_id % 3)::INT AS pages_without_text FROM files)"""
_VEC = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), probe AS (SELECT e AS q FROM v WHERE vec_id = 0)"""
_PAGES = """WITH pages AS (SELECT conv_id::VARCHAR AS path, turn::INT AS page, CASE WHEN (conv_id + turn) % 9 = 0 THEN '  x ' ELSE text END AS text FROM conversations)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), F.col("source").alias("root"), "text", F.octet_length("text").cast("long").alias("size"), hashing.content_hash(F.col("text").cast("binary")).alias("content_hash"))


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumn("signature", hashing.text_signature(F.col("text"), F.col("size"), 300))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("indexed", "needs_ocr", "pending_embedding", "unsupported", "empty", "error", "indexed", "indexed")])
    i = F.col("doc_id")
    return files(spark, sf_dir).withColumns({"status": F.element_at(names, (i % 8 + 1).cast("int")), "attempts": (i % 5).cast("int"), "chunk_count": (i % 7).cast("int"), "page_count": (i % 11 + 1).cast("int"), "pages_without_text": (i % 3).cast("int")})


def turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    body = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, "  x ").otherwise(F.col("text"))
    return c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("page"), body.alias("text"))


def probe_of(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


# -- scans ----------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN ext = '' THEN '(none)' ELSE ext END AS ext, count(*) AS n FROM (SELECT lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\\.[^./]+)$', 1)) AS ext FROM pages) GROUP BY 1""")
def ext_histogram(spark, sf_dir):
    return scan.extension_histogram(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "[^/]*$", 0).alias("name")))


@query("""WITH n AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '~$' ELSE '' END || 'p' || page_id::VARCHAR || ['.PDF', '.txt', '.exe', '.Md'][(page_id % 4 + 1)::INT] AS name FROM pages)
SELECT page_id, name FROM n WHERE NOT starts_with(name, '~$') AND NOT starts_with(name, '.~lock.') AND lower(regexp_extract(name, '^.+(\\.[^./]+)$', 1)) IN ('.pdf', '.txt', '.md')""")
def lock_file_filter(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in (".PDF", ".txt", ".exe", ".Md")])
    i = F.col("page_id")
    names = table(spark, sf_dir, "pages").select("page_id", F.concat(F.when(i % 5 == 0, "~$").otherwise(""), F.lit("p"), i.cast("string"), F.element_at(kinds, (i % 4 + 1).cast("int"))).alias("name"))
    return names.where(~scan.is_lock_file(F.col("name"), DEFAULTS.lock_file_patterns) & F.lower(scan.suffix(F.col("name"))).isin(".pdf", ".txt", ".md"))


@query(f"""{_FILES}, l AS (SELECT '/a/' || path AS abs_path, 0 AS ord, path, doc_id FROM files UNION ALL SELECT '/a/' || path, 1, source_less, doc_id FROM (SELECT path, doc_id, doc_id::VARCHAR || '.txt' AS source_less FROM files WHERE doc_id % 3 = 0))
SELECT abs_path, ord, path, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY abs_path ORDER BY ord) AS r FROM l) WHERE r = 1""")
def overlap_first_root(spark, sf_dir):
    f = files(spark, sf_dir)
    first = f.select(F.concat(F.lit("/a/"), "path").alias("abs_path"), F.lit(0).alias("ord"), "path", "doc_id")
    second = f.where("doc_id % 3 = 0").select(F.concat(F.lit("/a/"), "path").alias("abs_path"), F.lit(1).alias("ord"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "doc_id")
    return scan.first_root_wins(first.unionByName(second))


_IGNORES = """, marks AS (SELECT CASE WHEN doc_id % 2 = 0 THEN path ELSE '/r/' || path END AS path FROM files WHERE doc_id % 10 < 3 UNION ALL SELECT 'gone/' || doc_id::VARCHAR FROM files WHERE doc_id % 50 = 0)"""


def _listing_and_marks(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("abs_path", F.concat(F.lit("/r/"), "path"))
    marks = f.where("doc_id % 10 < 3").select(F.when(F.col("doc_id") % 2 == 0, F.translate("path", "/", "\\")).otherwise(F.col("abs_path")).alias("path"))
    return f, marks.unionByName(f.where("doc_id % 50 = 0").select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("path")))


@query(f"""{_FILES}{_IGNORES} SELECT path, doc_id FROM files WHERE path NOT IN (SELECT path FROM marks) AND '/r/' || path NOT IN (SELECT path FROM marks)""")
def ignore_list_anti(spark, sf_dir):
    listing, marks = _listing_and_marks(spark, sf_dir)
    return scan.without_ignored(listing, marks).select("path", "doc_id")


@query(f"""{_FILES}{_IGNORES} SELECT DISTINCT path FROM marks WHERE path NOT IN (SELECT path FROM files) AND path NOT IN (SELECT '/r/' || path FROM files)""")
def stale_ignores(spark, sf_dir):
    return scan.stale_ignores(*_listing_and_marks(spark, sf_dir))


_ROOTS = """WITH r AS (SELECT '/data/' || r_name AS root FROM region UNION ALL SELECT '/data/' || r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""{_ROOTS} SELECT a.root AS "inner", b.root AS "outer" FROM r a JOIN r b ON starts_with(a.root, b.root || '/')""")
def nested_source_pairs(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    under = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("/data/"), "r_name", F.lit("/"), "n_name").alias("root"))
    return scan.nested_roots(region.select(F.concat(F.lit("/data/"), "r_name").alias("root")).unionByName(under))


@query(f"""{_FILES} SELECT path, root, 'kept' AS origin FROM files WHERE root = 'src3' AND doc_id % 2 = 0 UNION ALL SELECT path, root, 'scanned' FROM files WHERE NOT (root = 'src3' AND doc_id % 2 = 0)""")
def kept_offline_union(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "root", "doc_id")
    current = f.where("NOT (root = 'src3' AND doc_id % 2 = 0)")
    kept = scan.kept_offline(f, current, spark.createDataFrame([("src3",)], "root string"))
    return kept.select("path", "root", F.lit("kept").alias("origin")).unionByName(current.select("path", "root", F.lit("scanned").alias("origin")))


@query(f"""{_FILES}, prev AS (SELECT path, size + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS size, doc_id::DOUBLE AS mtime, content_hash FROM files WHERE doc_id % 6 <> 5)
SELECT f.path, (p.size IS NOT NULL AND p.size = f.size) AS carry, coalesce(CASE WHEN p.size = f.size THEN p.content_hash END, f.content_hash) AS content_hash FROM files f LEFT JOIN prev p USING (path)""")
def incremental_scan(spark, sf_dir):
    f = files(spark, sf_dir)
    prev = f.where("doc_id % 6 <> 5").select("path", (F.col("size") + F.when(F.col("doc_id") % 4 == 1, 1).otherwise(0)).alias("size"), F.col("doc_id").cast("double").alias("mtime"), "content_hash")
    listing = f.select("path", "size", F.col("doc_id").cast("double").alias("mtime"), F.col("content_hash").alias("fresh"))
    out = scan.unchanged_or_hashed(listing, prev)
    return out.select("path", "carry", F.when(F.col("carry"), F.col("content_hash")).otherwise(F.col("fresh")).alias("content_hash"))


@query(f"""{_STATES} SELECT path, CASE WHEN status = 'indexed' THEN coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'old' END, ''), left(sha1('m2'), 12)) ELSE CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'old' END END AS embedding_fingerprint FROM states""")
def fingerprint_backfill(spark, sf_dir):
    stored = F.when(F.col("doc_id") % 2 == 0, "").otherwise("old")
    return states(spark, sf_dir).select("path", scan.backfilled_fingerprint(F.col("status"), stored, hashing.embedding_fingerprint(F.lit("m2"))).alias("embedding_fingerprint"))


# -- hashes and duplicates ------------------------------------------------------------------------


@query(f"""{_FILES} SELECT path, size, content_hash FROM files""")
def content_hash(spark, sf_dir):
    return files(spark, sf_dir).select("path", "size", "content_hash")


@query(f"""{_FILES} SELECT content_hash, string_agg(path, '|' ORDER BY path) AS paths, count(*) AS n FROM files GROUP BY content_hash HAVING count(*) > 1""")
def duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(files(spark, sf_dir)).select("content_hash", F.array_join("paths", "|").alias("paths"), "n")


@query(f"""{_SIGNED} SELECT path, signature FROM signed""")
def dedup_signature(spark, sf_dir):
    return signed(spark, sf_dir).select("path", "signature")


@query(f"""{_SIGNED} SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY signature ORDER BY length(path), path) AS r FROM signed) WHERE r > 1""")
def dedup_survivors(spark, sf_dir):
    return dedup.ignore_list(signed(spark, sf_dir).select("path", "signature"))


@query(f"""{_SIGNED}, r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY length(path), path) AS r FROM signed) SELECT signature, max(path) FILTER (r = 1) AS kept, string_agg(path, '|' ORDER BY path) FILTER (r > 1) AS ignored FROM r GROUP BY signature HAVING count(*) > 1""")
def dedup_report(spark, sf_dir):
    return dedup.kept_and_ignored(signed(spark, sf_dir).select("path", "signature")).select("signature", "kept", F.array_join("ignored", "|").alias("ignored"))


@query(f"""{_SIGNED} SELECT path, signature FROM signed WHERE doc_id % 3 <> 0""")
def dedup_resume(spark, sf_dir):
    s = signed(spark, sf_dir)
    return dedup.not_done(s, s.where("doc_id % 3 = 0")).select("path", "signature")


# -- changes --------------------------------------------------------------------------------------

# today: all but every 7th; before: all but every 5th, edited every 4th, moved every 11th
_SNAP = f"""{_FILES}, cur AS (SELECT doc_id, path, content_hash FROM files WHERE doc_id % 7 <> 0),
prev AS (SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'old/' || path ELSE path END AS path, CASE WHEN doc_id % 4 = 1 THEN 'x' || content_hash ELSE content_hash END AS content_hash FROM files WHERE doc_id % 5 <> 0),
nw AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM cur WHERE path NOT IN (SELECT path FROM prev)),
gone AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM prev WHERE path NOT IN (SELECT path FROM cur)),
moves AS (SELECT nw.path, gone.path AS old_path FROM nw JOIN gone USING (content_hash, n)),
ch AS (SELECT 0 AS phase, c.path, CASE WHEN m.old_path IS NOT NULL THEN 'MOVED' WHEN p.path IS NULL THEN 'NEW' WHEN p.content_hash <> c.content_hash THEN 'MODIFIED' ELSE 'UNCHANGED' END AS type, m.old_path FROM cur c LEFT JOIN prev p ON p.path = c.path LEFT JOIN moves m ON m.path = c.path
UNION ALL SELECT 1, path, 'DELETED', NULL FROM gone WHERE path NOT IN (SELECT old_path FROM moves))"""


def _snapshots(spark, sf_dir):
    f = files(spark, sf_dir)
    i = F.col("doc_id")
    previous = f.where(i % 5 != 0).select("doc_id", F.when(i % 11 == 3, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"), F.when(i % 4 == 1, F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash")).alias("content_hash"))
    return f.where(i % 7 != 0).select("doc_id", "path", "content_hash"), previous


@query(f"""{_SNAP} SELECT phase, path, type, old_path FROM ch""")
def classify_changes(spark, sf_dir):
    current, previous = _snapshots(spark, sf_dir)
    return changes.classify(current, previous.drop("doc_id")).select("phase", "path", "type", "old_path")


@query(f"""{_SNAP} SELECT t.type, count(ch.path) AS n FROM (VALUES ('NEW'), ('MODIFIED'), ('MOVED'), ('DELETED'), ('UNCHANGED')) t(type) LEFT JOIN ch USING (type) GROUP BY t.type""")
def change_counts(spark, sf_dir):
    current, previous = _snapshots(spark, sf_dir)
    return changes.change_counts(changes.classify(current, previous.drop("doc_id")))


@query(f"""{_FILES}, a AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM files WHERE doc_id % 2 = 0), b AS (SELECT path AS old_path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM files WHERE doc_id % 2 = 1) SELECT path, old_path FROM a JOIN b USING (content_hash, n)""")
def move_match(spark, sf_dir):
    f = files(spark, sf_dir)
    return changes.move_pairs(f.where("doc_id % 2 = 0"), f.where("doc_id % 2 = 1"))


_REASON = """CASE WHEN status = 'needs_ocr' THEN CASE WHEN ocr IS DISTINCT FROM 'fp2' THEN 'retry: OCR available' END
WHEN status = 'error' AND attempts >= 3 THEN NULL
WHEN pdf AND pages_without_text > 0 AND ocr IS DISTINCT FROM 'fp2' THEN 'ocr: ' || pages_without_text::VARCHAR || ' page(s) without text'
WHEN status = 'indexed' AND model <> '' AND model <> 'new' THEN 're-embed: embedding model changed'
WHEN status IN ('needs_ocr', 'pending_embedding', 'error') THEN 'retry: previous run ended in ' || status END"""


@query(f"""{_STATES}, s AS (SELECT *, doc_id % 4 = 0 AS pdf, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'fp1' ELSE 'fp2' END AS ocr, ['', 'old', 'new'][(doc_id % 3 + 1)::INT] AS model FROM states) SELECT path, {_REASON} AS reason FROM s""")
def reprocess_reason(spark, sf_dir):
    i = F.col("doc_id")
    path = F.when(i % 4 == 0, F.concat("path", F.lit(".PDF"))).otherwise(F.col("path"))
    ocr_print = F.when(i % 3 == 0, F.lit(None).cast("string")).when(i % 3 == 1, "fp1").otherwise("fp2")
    model = F.element_at(F.array(F.lit(""), F.lit("old"), F.lit("new")), (i % 3 + 1).cast("int"))
    why = changes.reprocess_reason(F.col("status"), F.col("attempts"), path, F.col("pages_without_text"), ocr_print, model, F.lit(3), F.lit("fp2"), F.lit("new"), F.lit(True))
    return states(spark, sf_dir).select("path", why.alias("reason"))


@query(f"""{_STATES} SELECT path, status, CASE WHEN status IN ('needs_ocr', 'pending_embedding', 'error') THEN coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE attempts END, 0) + 1 ELSE 0 END AS attempts FROM states""")
def attempts_update(spark, sf_dir):
    before = F.when(F.col("doc_id") % 9 == 0, F.lit(None).cast("int")).otherwise(F.col("attempts"))
    return states(spark, sf_dir).select("path", "status", changes.attempts_after(F.col("status"), before).alias("attempts"))


@query(f"""{_STATES} SELECT 'new/' || path AS path, path AS old_path, coalesce(CASE WHEN doc_id % 2 = 0 THEN status END, 'fresh') AS status, coalesce(CASE WHEN doc_id % 3 = 0 THEN chunk_count END, -1) AS chunk_count FROM states WHERE doc_id % 4 = 0""")
def move_carry(spark, sf_dir):
    s = states(spark, sf_dir)
    old = s.select("path", F.when(F.col("doc_id") % 2 == 0, F.col("status")).alias("status"), F.when(F.col("doc_id") % 3 == 0, F.col("chunk_count")).alias("chunk_count"))
    moved = s.where("doc_id % 4 = 0").select(F.concat(F.lit("new/"), "path").alias("path"), F.col("path").alias("old_path"), F.lit("fresh").alias("status"), F.lit(-1).alias("chunk_count"))
    return changes.carried(moved, old, ["status", "chunk_count"])


@query(f"""{_STATES} SELECT path, CASE WHEN status IN ('needs_ocr', 'pending_embedding', 'error') THEN 'MODIFIED' ELSE 'MOVED' END AS type FROM states WHERE doc_id % 2 = 0""")
def unindexed_moves(spark, sf_dir):
    s = states(spark, sf_dir)
    moved = s.where("doc_id % 2 = 0").select("path", F.lit("MOVED").alias("type"), F.concat(F.lit("old/"), "path").alias("old_path"))
    return changes.rewrite_unindexed_moves(moved, s.select(F.concat(F.lit("old/"), "path").alias("path"), "status")).select("path", "type")


@query(f"""{_STATES}, x AS (SELECT path, doc_id, content_hash AS h, size, chunk_count, page_count, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE length(text) % 400 END AS chars, doc_id % 2 = 0 AS pdf FROM states)
SELECT path, CASE WHEN doc_id % 17 = 0 THEN 'error' WHEN doc_id % 19 = 0 THEN 'empty' WHEN doc_id % 23 = 0 THEN 'unsupported' WHEN doc_id % 29 = 0 THEN 'error'
WHEN chars = 0 AND NOT pdf THEN 'empty' WHEN chars = 0 AND doc_id % 5 = 0 THEN 'error' WHEN chars = 0 THEN 'needs_ocr'
WHEN pdf AND chars / page_count::DOUBLE < 50 AND doc_id % 5 = 0 THEN 'error' WHEN pdf AND chars / page_count::DOUBLE < 50 AND doc_id % 3 > 0 THEN 'needs_ocr'
WHEN chunk_count = 0 THEN 'empty' WHEN doc_id % 31 = 0 THEN 'pending_embedding' ELSE 'indexed' END AS status FROM x""")
def final_statuses(spark, sf_dir):
    i = F.col("doc_id")
    chars = F.when(i % 13 == 0, 0).otherwise(F.char_length("text") % 400)
    status = changes.final_status(
        F.when(i % 19 == 0, 0).otherwise(F.col("size")), F.when(i % 17 == 0, "").otherwise(F.col("content_hash")), i % 23 != 0, F.when(i % 29 == 0, "bad"), i % 2 == 0, chars, F.col("page_count"), 50,
        F.lit(True), F.when(i % 5 == 0, "failed"), F.when(i % 3 == 0, 1).otherwise(0), F.col("chunk_count"), i % 31 != 0,
    )
    return states(spark, sf_dir).select("path", status.alias("status"))


@query("""SELECT left(sha1('hashing-64'), 12) AS embedding_fingerprint, left(sha1('hybrid|300|eng+kan|50|200|http://x|m|api+local'), 12) AS ocr_fingerprint""")
def fingerprints(spark, sf_dir):
    settings = [F.lit(x) for x in ("hybrid", 300, "eng+kan", 50, 200, "http://x", "m")]
    return spark.range(1).select(hashing.embedding_fingerprint(F.lit(DEFAULTS.embedding_model)).alias("embedding_fingerprint"), hashing.ocr_fingerprint(settings, F.array(F.lit("local"), F.lit("api"))).alias("ocr_fingerprint"))


@query(f"""{_SIGNED}, gone AS (SELECT signature, max('old/' || path) AS old_path FROM signed WHERE doc_id % 3 = 0 GROUP BY signature) SELECT path AS new_path, old_path FROM signed JOIN gone USING (signature) WHERE doc_id % 3 = 1""")
def rename_hints(spark, sf_dir):
    s = signed(spark, sf_dir)
    old = s.where("doc_id % 3 = 0").select(F.concat(F.lit("old/"), "path").alias("path"), "signature", F.lit("DELETED").alias("type"))
    both = old.unionByName(s.where("doc_id % 3 = 1").select("path", "signature", F.lit("NEW").alias("type")))
    return changes.rename_hints(both.select("path", "type"), both.select("path", "signature"))


# -- pages and OCR --------------------------------------------------------------------------------


@query(f"""{_PAGES} SELECT path, count(*) AS n_pages, sum(length(trim(text)))::BIGINT AS chars, sum(length(trim(text))) / count(*) >= 50 AS has_text_layer, count(*) FILTER (length(trim(text)) < 10) AS blank_pages FROM pages GROUP BY path""")
def text_layer(spark, sf_dir):
    return ocr.text_layers(turn_pages(spark, sf_dir), DEFAULTS.ocr_min_chars_per_page, DEFAULTS.blank_page_chars)


@query(f"""{_PAGES} SELECT path, page FROM pages WHERE length(trim(text)) < 10""")
def blank_pages(spark, sf_dir):
    return turn_pages(spark, sf_dir).where(text.stripped_length(F.col("text")) < DEFAULTS.blank_page_chars).select("path", "page")


_CAND = f"""{_PAGES}, cand AS (SELECT path, page, row_number() OVER (PARTITION BY path ORDER BY page) AS nth FROM pages WHERE length(trim(text)) < 120 QUALIFY nth <= 2)"""


@query(f"""{_CAND} SELECT path, page, nth::INT AS nth FROM cand""")
def ocr_candidates_capped(spark, sf_dir):
    return ocr.candidates(turn_pages(spark, sf_dir), 120, 2).select("path", "page", "nth")


@query(f"""{_CAND} SELECT path, page, row_number() OVER (ORDER BY path, page) <= 40 AS admitted FROM cand""")
def ocr_budget(spark, sf_dir):
    return ocr.admitted(ocr.candidates(turn_pages(spark, sf_dir), 120, 2), 40).select("path", "page", "admitted")


@query(
    f"""{_PAGES}, cand AS (SELECT path, page, row_number() OVER (PARTITION BY path ORDER BY page) AS nth FROM pages WHERE length(trim(text)) < 120),
    k AS (SELECT path, page, CASE WHEN nth > 2 THEN 'capped' WHEN page % 2 = 0 AND path::BIGINT % 3 > 0 THEN 'cached' ELSE 'read' END AS kind FROM cand)
    SELECT path, page, CASE WHEN kind = 'read' AND row_number() OVER (PARTITION BY kind ORDER BY path, page) > 40 THEN 'deferred' ELSE kind END AS plan FROM k"""
)
def ocr_plan(spark, sf_dir):
    p = turn_pages(spark, sf_dir).withColumns({"content_hash": F.lit("h"), "fingerprint": F.lit("f2")})
    cache = p.where("page % 2 = 0 AND CAST(path AS BIGINT) % 3 > 0").select("path", "page", "content_hash", "fingerprint", F.concat("text", F.lit("!")).alias("text"))
    settings = dataclasses.replace(DEFAULTS, ocr_min_chars_per_page=120, ocr_max_pages_per_file=2)
    return recognise.planned(p, cache, settings, 40).select("path", "page", "plan")


_READ = """WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN left(text, 150) ELSE text END AS p, (conv_id + turn) % 5 = 0 AS pf, text || ' more' AS e, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE turn % 4 <> 1 END AS ok FROM conversations),
s AS (SELECT *, CASE WHEN pf THEN '' ELSE p END AS f FROM r), t AS (SELECT *, ok IS NOT NULL AND (pf OR length(trim(f)) < 200) AS escalated FROM s)"""


def _read_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    asked, chosen, failed = ocr.chosen_text(F.when(conv % 4 == 0, F.left("text", F.lit(150))).otherwise(F.col("text")), (conv + turn) % 5 == 0, F.concat("text", F.lit(" more")), F.when(conv % 3 != 0, turn % 4 != 1), 200)
    return c.select("conv_id", "turn", asked.alias("escalated"), chosen.alias("text"), failed.alias("failed"))


@query(f"""{_READ} SELECT conv_id, turn, escalated, CASE WHEN escalated AND ok AND length(trim(e)) > length(trim(f)) THEN e ELSE f END AS text, pf AND NOT (escalated AND coalesce(ok, false)) AS failed FROM t""")
def ocr_escalation_choice(spark, sf_dir):
    return _read_pages(spark, sf_dir)


@query(f"""{_READ}, f2 AS (SELECT conv_id, count(*) FILTER (pf AND NOT (escalated AND coalesce(ok, false))) AS errors, max(turn) > 5 AS incomplete FROM t GROUP BY conv_id) SELECT conv_id, errors, errors = 0 AND NOT incomplete AS settled FROM f2""")
def ocr_settled(spark, sf_dir):
    per = _read_pages(spark, sf_dir).groupBy("conv_id").agg(F.count_if("failed").alias("errors"), (F.max("turn") > 5).alias("incomplete"))
    return per.select("conv_id", "errors", ocr.settled(F.lit(True), F.col("incomplete"), F.col("errors"), F.lit(None)).alias("settled"))


@query(f"""{_READ} SELECT count(*) AS pages, count(*) FILTER (escalated) AS api_pages, round(count(*) FILTER (escalated) * 0.0001, 4)::DOUBLE AS est_cost FROM t""")
def ocr_cost(spark, sf_dir):
    return ocr.run_cost(_read_pages(spark, sf_dir), DEFAULTS.ocr_api_price).withColumn("est_cost", F.col("est_cost").cast("double"))


@query(f"""{_PAGES} SELECT path, page, CASE WHEN page % 2 = 0 AND path::BIGINT % 3 > 0 THEN text || '!' END AS cached_text FROM pages""")
def ocr_cache(spark, sf_dir):
    p = turn_pages(spark, sf_dir).withColumns({"content_hash": F.lit("h"), "fingerprint": F.lit("f2")})
    stale = F.when(F.col("path").cast("long") % 3 == 0, "f1").otherwise("f2")
    cache = p.where("page % 2 = 0").select("path", "page", "content_hash", stale.alias("fingerprint"), F.concat("text", F.lit("!")).alias("text"))
    return ocr.cached(p, cache).select("path", "page", "cached_text")


# -- text -----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, array_to_string([c FOR c IN [o_orderkey::VARCHAR, CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE trim('  ' || o_orderpriority || ' ') END] IF c IS NOT NULL AND trim(c) <> ''], ' | ') AS line FROM orders ORDER BY o_orderkey LIMIT 5000""")
def render_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cells = o.select("o_orderkey", k.cast("string").alias("a"), F.when(k % 5 == 0, "  ").otherwise(F.col("o_orderstatus")).alias("b"), F.when(k % 3 != 0, F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).alias("c"))
    return chunking.rendered_rows(cells, "o_orderkey", ["a", "b", "c"], DEFAULTS.spreadsheet_max_rows)


@query("""SELECT doc_id, i::INT AS i, p AS piece FROM (SELECT doc_id, unnest(l) AS p, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.;:!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents))""")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentence_pieces(F.col("text"))).alias("i", "piece"))


@query("""WITH d AS (SELECT doc_id::VARCHAR AS path, 'intro text' || chr(10) || 'Rule ' || doc_id::VARCHAR || '.1 general' || chr(10) || text || chr(10) || '12. Payment of dues' || chr(10) || ' tail ' AS t FROM documents),
l AS (SELECT path, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS i FROM d),
h AS (SELECT *, regexp_full_match(line, '\\s*(?:(?i:(?:section|rule|regulation|clause|article|chapter|part|schedule|annexure|form|order|notification|circular)\\b.{0,80})|[A-Z][A-Z0-9 ,&()/.\\-]{6,}|\\d+(?:\\.\\d+)*[.)]\\s+\\S.{5,})\\s*') AS head FROM l),
b AS (SELECT *, sum(head::INT) OVER (PARTITION BY path ORDER BY i) AS block FROM h)
SELECT path, block::BIGINT AS block, CASE WHEN bool_or(head) THEN left(trim(min_by(line, i)), 120) END AS heading, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS body FROM b GROUP BY path, block HAVING regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') <> ''""")
def block_split(spark, sf_dir):
    body = F.concat(F.lit("intro text\nRule "), F.col("doc_id").cast("string"), F.lit(".1 general\n"), "text", F.lit("\n12. Payment of dues\n tail "))
    return chunking.line_blocks(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), body.alias("text")))


_TEXT = "'intro text' || chr(10) || 'Rule ' || doc_id || '.1 general' || chr(10) || coalesce(text, '') || chr(10) || '12. Payment of dues' || chr(10) || ' tail '"
_CHUNKS = f"""WITH RECURSIVE given AS (SELECT doc_id, string_split({_TEXT}, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM given),
h AS (SELECT *, regexp_full_match(line, '\\s*(?:(?i:(?:section|rule|regulation|clause|article|chapter|part|schedule|annexure|form|order|notification|circular)\\b.{{0,80}})|[A-Z][A-Z0-9 ,&()/.\\-]{{6,}}|\\d+(?:\\.\\d+)*[.)]\\s+\\S.{{5,}})\\s*') AS head FROM l),
b AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM h),
d AS (SELECT doc_id, block, CASE WHEN bool_or(head) THEN left(trim(min_by(line, i)), 120) END AS heading, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS t FROM b GROUP BY doc_id, block),
s AS (SELECT doc_id, block, CASE WHEN length(t) <= 1200 THEN [t] ELSE string_split(regexp_replace(t, '([.;:!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS l FROM d WHERE t <> ''),
j(doc_id, block, l, i, cur, done) AS (
  SELECT doc_id, block, l, 1, l[1], NULL::VARCHAR FROM s
  UNION ALL SELECT doc_id, block, l, i + 1, CASE WHEN i >= len(l) THEN NULL WHEN length(cur) + 1 + length(l[i + 1]) <= 1200 THEN cur || ' ' || l[i + 1] ELSE l[i + 1] END, CASE WHEN i < len(l) AND length(cur) + 1 + length(l[i + 1]) <= 1200 THEN NULL ELSE cur END FROM j WHERE i <= len(l)),
jj AS (SELECT doc_id, block, i, done FROM j WHERE done IS NOT NULL),
p AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY block, i, k) AS n, substr(done, (k * 1200 + 1)::BIGINT, 1200) AS piece FROM (SELECT doc_id, block, i, done, unnest(range(0, greatest(1, (length(done) + 1199) // 1200))) AS k FROM jj)),
pl AS (SELECT doc_id, list(piece ORDER BY n) AS l, list(coalesce(heading, '') ORDER BY n) AS hs FROM p JOIN d USING (doc_id, block) GROUP BY doc_id),
f(doc_id, l, hs, i, buf, sec, done, was) AS (
  SELECT doc_id, l, hs, 1, l[1], hs[1], NULL::VARCHAR, NULL::VARCHAR FROM pl
  UNION ALL SELECT doc_id, l, hs, i + 1, CASE WHEN i >= len(l) THEN NULL WHEN goes THEN buf || chr(10) || l[i + 1] ELSE right(buf, 200) || chr(10) || l[i + 1] END, CASE WHEN goes THEN sec ELSE hs[i + 1] END, CASE WHEN i < len(l) AND goes THEN NULL ELSE buf END, sec
  FROM (SELECT *, length(buf) + 1 + length(l[i + 1]) <= 1200 OR length(buf) < 200 AS goes FROM f) WHERE i <= len(l)),
c AS (SELECT doc_id, i, was, regexp_replace(done, '^\\s+|\\s+$', '', 'g') AS t FROM f WHERE done IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN length(t) >= 200 OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM c)),
m AS (SELECT doc_id, grp, min_by(was, i) AS section, string_agg(t, chr(10) ORDER BY i) AS text FROM g GROUP BY doc_id, grp),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS chunk, section, text FROM m WHERE trim(text) <> '')"""


def _chunks(spark, sf_dir):
    f = files(spark, sf_dir)
    pages = f.select("path", F.lit(0).alias("page_idx"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("label"), "text")
    return chunking.chunk_pages(pages, DEFAULTS), f


@query(_CHUNKS + """ SELECT doc_id, chunk::INT AS chunk, section, md5(text) AS text_md5 FROM n""")
def chunk_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    whole = F.concat(F.lit("intro text\nRule "), F.col("doc_id").cast("string"), F.lit(".1 general\n"), F.coalesce("text", F.lit("")), F.lit("\n12. Payment of dues\n tail "))
    pages = d.select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("page_idx"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("label"), whole.alias("text"))
    made = chunking.numbered(chunking.chunk_pages(pages, DEFAULTS))
    return made.select(F.col("path").cast("long").alias("doc_id"), "chunk", F.coalesce("section", F.lit("")).alias("section"), F.md5("text").alias("text_md5"))


_CUTS = f"""{_FILES}, cut AS (SELECT path, root, content_hash, unnest(range(0, (length(text) + 999) // 1000)) AS chunk, text FROM files), rows AS (SELECT left(sha1(concat_ws('|', path, content_hash, chunk::VARCHAR)), 20) AS chunk_id, path AS source, root, chunk::INT AS chunk, count(*) OVER (PARTITION BY path)::INT AS chunk_total, substr(text, chunk * 1000 + 1, 1000) AS text FROM cut)"""


def _cuts(spark, sf_dir):
    f = files(spark, sf_dir)
    n = F.ceil(F.char_length("text") / 1000).cast("int")
    cut = f.where(F.char_length("text") > 0).select("path", F.explode(F.sequence(F.lit(0), n - 1)).alias("page_idx"), F.col("text").alias("t"))
    made = cut.select("path", "page_idx", F.lit(None).cast("int").alias("page"), F.lit(0).alias("piece"), F.lit(None).cast("string").alias("section"), F.substring("t", F.col("page_idx") * 1000 + 1, F.lit(1000)).alias("text"))
    return chunking.store_rows(made, f)


@query(f"""{_CUTS} SELECT chunk_id, source, chunk FROM rows""")
def chunk_ids(spark, sf_dir):
    return _cuts(spark, sf_dir).select("chunk_id", "source", "chunk")


@query(f"""{_CUTS} SELECT source, chunk, chunk_total, -1 AS page, '' AS section, 'txt' AS file_type, md5(text) AS text_md5 FROM rows""")
def chunk_metadata(spark, sf_dir):
    return _cuts(spark, sf_dir).select("source", "chunk", "chunk_total", "page", "section", "file_type", F.md5("text").alias("text_md5"))


# -- store ----------------------------------------------------------------------------------------

_STORE = f"""{_FILES}, st AS (SELECT path AS source, root, 0 AS chunk, content_hash AS chunk_id, doc_id FROM files)"""


def _stored(spark, sf_dir):
    return files(spark, sf_dir).select(F.col("path").alias("source"), "root", F.lit(0).alias("chunk"), F.col("content_hash").alias("chunk_id"), "doc_id")


@query(f"""{_STORE} SELECT source, root, chunk, CASE WHEN doc_id % 3 = 0 THEN 'v2' ELSE chunk_id END AS chunk_id FROM st UNION ALL SELECT source, root, 1, 'v2b' FROM st WHERE doc_id % 3 = 0""")
def store_replace(spark, sf_dir):
    st = _stored(spark, sf_dir)
    new = st.where("doc_id % 3 = 0")
    fresh = new.select("source", "root", F.lit(0).alias("chunk"), F.lit("v2").alias("chunk_id")).unionByName(new.select("source", "root", F.lit(1).alias("chunk"), F.lit("v2b").alias("chunk_id")))
    return store.replace(st.drop("doc_id"), fresh)


@query(f"""{_STORE} SELECT source, root, chunk, chunk_id FROM st WHERE doc_id % 3 <> 0""")
def store_delete(spark, sf_dir):
    st = _stored(spark, sf_dir)
    return store.delete(st, st.where("doc_id % 3 = 0")).drop("doc_id")


@query(f"""{_STORE} SELECT CASE WHEN doc_id % 4 = 0 THEN 'moved/' || source ELSE source END AS source, CASE WHEN doc_id % 4 = 0 THEN 'r2' ELSE root END AS root, chunk, chunk_id FROM st""")
def store_relabel(spark, sf_dir):
    st = _stored(spark, sf_dir)
    moves = st.where("doc_id % 4 = 0").select(F.col("source").alias("old_path"), F.concat(F.lit("moved/"), "source").alias("path"), F.lit("r2").alias("root"))
    return store.relabel(st.drop("doc_id"), moves)


# -- reports --------------------------------------------------------------------------------------


@query(f"""{_STATES} SELECT status, count(*) AS n, sum(chunk_count)::BIGINT AS chunks, CASE WHEN status = 'indexed' THEN 'chunks_indexed' ELSE 'chunks_pending' END AS bucket FROM states GROUP BY status""")
def outcome_counts(spark, sf_dir):
    return reports.outcome_counts(states(spark, sf_dir))


@query(f"""{_STATES}, r AS (SELECT status, path, row_number() OVER (PARTITION BY status ORDER BY path) AS i FROM states WHERE status <> 'indexed') SELECT status, count(*) AS n, string_agg(path, '|' ORDER BY path) FILTER (i <= 5) AS first, greatest(count(*) - 5, 0) AS more FROM r GROUP BY status""")
def not_indexed_report(spark, sf_dir):
    return reports.not_indexed(states(spark, sf_dir))


@query(f"""{_STATES} SELECT count(*) FILTER (status = 'needs_ocr') AS needs_ocr, count(*) FILTER (status = 'pending_embedding') AS pending_embedding, count(*) FILTER (status = 'error') AS error, CASE WHEN count(*) FILTER (status IN ('needs_ocr', 'pending_embedding', 'error')) > 0 THEN 2 ELSE 0 END AS exit_code FROM states""")
def strict_blocked(spark, sf_dir):
    return reports.strict_blocked(states(spark, sf_dir))


@query(f"""{_STATES} SELECT count(*) AS n_files, sum(page_count)::BIGINT AS n_pages, sum(pages_without_text)::BIGINT AS n_blank, round(sum(pages_without_text) / greatest(sum(page_count), 1), 6)::DOUBLE AS blank_share FROM states WHERE status IN ('indexed', 'pending_embedding')""")
def audit_totals(spark, sf_dir):
    return reports.audit_totals(states(spark, sf_dir))


@query(f"""{_STATES} SELECT count(*) AS n_files, coalesce(sum(pages_without_text), 0)::BIGINT AS n_pages FROM states WHERE status = 'indexed' AND pages_without_text > 0""")
def mixed_files(spark, sf_dir):
    return reports.mixed_files(states(spark, sf_dir))


@query(f"""{_STATES} SELECT string_split(path, '/')[1] AS folder, count(*) AS n FROM states WHERE status = 'needs_ocr' GROUP BY 1""")
def folder_counts(spark, sf_dir):
    return reports.folder_counts(states(spark, sf_dir), "needs_ocr")


@query(f"""{_STATES}{_IGNORES}, dup AS (SELECT string_agg(path, ' = ' ORDER BY path) AS g FROM files GROUP BY content_hash HAVING count(*) > 1), stale AS (SELECT DISTINCT path FROM marks WHERE path NOT IN (SELECT path FROM files) AND path NOT IN (SELECT '/r/' || path FROM files))
SELECT 'overlap' AS code, count(*)::VARCHAR || ' file(s) reached through several roots' AS message FROM files WHERE doc_id % 3 = 0 HAVING count(*) > 0
UNION ALL SELECT 'lock_files', count(*)::VARCHAR || ' lock file(s) skipped' FROM files WHERE doc_id % 97 = 0 HAVING count(*) > 0
UNION ALL SELECT 'duplicates', (SELECT count(*) FROM dup)::VARCHAR || ' group(s) of equal content: ' || string_agg(g, ', ' ORDER BY g) || CASE WHEN (SELECT count(*) FROM dup) > 3 THEN ' (+' || ((SELECT count(*) FROM dup) - 3)::VARCHAR || ' more)' ELSE '' END FROM (SELECT g FROM dup ORDER BY g LIMIT 3) HAVING count(*) > 0
UNION ALL SELECT 'stale_ignores', (SELECT count(*) FROM stale)::VARCHAR || ' ignore entr(ies) without a file: ' || string_agg(path, ', ' ORDER BY path) || CASE WHEN (SELECT count(*) FROM stale) > 3 THEN ' (+' || ((SELECT count(*) FROM stale) - 3)::VARCHAR || ' more)' ELSE '' END FROM (SELECT path FROM stale ORDER BY path LIMIT 3) HAVING count(*) > 0
UNION ALL SELECT 'mixed', count(*)::VARCHAR || ' file(s) with ' || sum(pages_without_text)::VARCHAR || ' page(s) without text' FROM states WHERE status = 'indexed' AND pages_without_text > 0 HAVING count(*) > 0""")
def run_warnings(spark, sf_dir):
    f, s = files(spark, sf_dir), states(spark, sf_dir)
    listing, marks = _listing_and_marks(spark, sf_dir)
    return reports.warnings(f.where("doc_id % 3 = 0"), f.where("doc_id % 97 = 0"), dedup.duplicate_groups(f), scan.stale_ignores(listing, marks), reports.mixed_files(s))


# -- retrieval ------------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")



_TOP = f"""{_VEC}, s AS (SELECT vec_id AS chunk_id, list_cosine_similarity(e, q) AS score FROM v, probe), pool AS (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 24)"""


@query(f"""{_TOP} SELECT chunk_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM pool WHERE score >= 0.0) WHERE rank <= 6""")
def vector_topk(spark, sf_dir):
    return retrieval.top_hits(_vectors(spark, sf_dir), probe_of(spark, sf_dir)).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""{_TOP} SELECT chunk_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM pool WHERE score >= 0.3) WHERE rank <= 6""")
def vector_topk_floor(spark, sf_dir):
    return retrieval.top_hits(_vectors(spark, sf_dir), probe_of(spark, sf_dir), top_k=6, min_score=0.3).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""{_VEC} SELECT qid, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, list_cosine_similarity(v.e, q.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id) AS rank FROM v, v q WHERE q.vec_id % 100 = 0) WHERE rank <= 5""")
def batch_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    probes = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("probe"))
    return retrieval.top_hits_of_each(v, probes, 5).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""{_VEC}, s AS (SELECT vec_id AS chunk_id, list_cosine_similarity(e, q) AS score FROM v JOIN documents ON doc_id = vec_id, probe WHERE contains(text, 'the')), pool AS (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 24) SELECT chunk_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM pool WHERE score >= 0.0) WHERE rank <= 6""")
def contains_topk(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.top_hits(_vectors(spark, sf_dir).join(d, "chunk_id"), probe_of(spark, sf_dir), contains="the").select("chunk_id", F.round("score", 6).alias("score"), "rank")


_HITS = f"""{_FILES}, hits AS (SELECT doc_id, doc_id // 4 AS qid, (doc_id % 4 + 1)::INT AS rank, text, path AS source, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 50)::INT ELSE -1 END AS page, CASE WHEN doc_id % 2 = 0 THEN 'S' || (doc_id % 9)::VARCHAR ELSE '' END AS section, ['xlsx', 'pdf', 'csv', 'txt', 'md'][(doc_id % 5 + 1)::INT] AS file_type FROM files),
cited AS (SELECT *, CASE WHEN page > 0 THEN source || ', p.' || page::VARCHAR WHEN section <> '' AND file_type IN ('xlsx', 'xlsm', 'xls', 'csv') THEN source || ', sheet "' || section || '"' WHEN section <> '' THEN source || ', ' || section ELSE source END AS cite FROM hits)"""


def _hits(spark, sf_dir):
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("xlsx", "pdf", "csv", "txt", "md")])
    h = files(spark, sf_dir).select("doc_id", F.floor(i / 4).cast("long").alias("qid"), (i % 4 + 1).cast("int").alias("rank"), "text", F.col("path").alias("source"), F.when(i % 3 == 0, (i % 50).cast("int")).otherwise(-1).alias("page"), F.when(i % 2 == 0, F.concat(F.lit("S"), (i % 9).cast("string"))).otherwise("").alias("section"), F.element_at(kinds, (i % 5 + 1).cast("int")).alias("file_type"))
    return h.withColumn("cite", retrieval.citation(F.col("source"), F.col("page"), F.col("section"), F.col("file_type")))


@query(f"""{_HITS} SELECT doc_id, cite FROM cited""")
def citations(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", "cite")


@query(f"""{_HITS}, b AS (SELECT qid, rank, '[' || rank::VARCHAR || '] ' || cite || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS block FROM cited),
u AS (SELECT *, coalesce(sum(least(length(block), 3000) + 2) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b),
k AS (SELECT qid, count(*) AS n_blocks, bool_or(length(block) > 3000) AS clipped, md5(string_agg(left(block, 3000), chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM u WHERE used = 0 OR used + length(block) <= 3000 GROUP BY qid)
SELECT qid, context_md5, n_blocks::INT AS n_blocks, clipped OR n_blocks < given AS truncated FROM k JOIN (SELECT qid, count(*) AS given FROM b GROUP BY qid) USING (qid)""")
def context_budget(spark, sf_dir):
    return retrieval.contexts(_hits(spark, sf_dir), 3000, "qid").select("qid", F.md5("context").alias("context_md5"), "n_blocks", "truncated")


_ANSWERS = """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 7 = 1 THEN 'No marker [1234].' ELSE 'See [' || (doc_id % 4 + 1)::VARCHAR || '] and [' || (doc_id % 9)::VARCHAR || '], [' || (doc_id % 4 + 1)::VARCHAR || '].' END AS answer FROM documents),
u AS (SELECT doc_id, answer, list_sort(list_distinct([x::INT FOR x IN regexp_extract_all(answer, '\\[(\\d{1,3})\\]', 1)])) AS used FROM a), w AS (SELECT *, [x FOR x IN used IF x BETWEEN 1 AND 4] AS cited, [x FOR x IN used IF NOT x BETWEEN 1 AND 4] AS unknown FROM u)"""


@query(f"""{_ANSWERS} SELECT doc_id, array_to_string(cited, '|') AS cited, CASE WHEN len(unknown) > 0 THEN 'answer cites excerpt(s) that were not provided: ' || array_to_string(['[' || x::VARCHAR || ']' FOR x IN unknown], ', ') WHEN len(used) = 0 AND trim(answer) <> '' THEN 'answer contains no [n] citations' ELSE '' END AS warning FROM w""")
def validate_citations(spark, sf_dir):
    i = F.col("doc_id")
    mark = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    answer = F.when(i % 7 == 0, " ").when(i % 7 == 1, "No marker [1234].").otherwise(F.concat(F.lit("See "), mark(i % 4 + 1), F.lit(" and "), mark(i % 9), F.lit(", "), mark(i % 4 + 1), F.lit(".")))
    given = table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"), F.array(*[F.lit(n) for n in (1, 2, 3, 4)]).alias("ranks"))
    return retrieval.validated(given).select("doc_id", F.array_join("cited", "|").alias("cited"), "warning")


@query(f"""{_HITS}, f AS (SELECT qid, rank, cite, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM cited) SELECT qid, md5(string_agg('[' || rank::VARCHAR || '] ' || cite || chr(10) || CASE WHEN length(t) > 600 THEN rtrim(left(t, 600)) || '…' ELSE t END, chr(10) || chr(10) ORDER BY rank)) AS answer_md5 FROM f GROUP BY qid""")
def extractive_answer(spark, sf_dir):
    return retrieval.extractive_answer(_hits(spark, sf_dir), "qid").select("qid", F.md5("answer").alias("answer_md5"))


@query()
def query_result_json(spark, sf_dir):
    from lodestar.plans.question import answer_question

    chunks = _vectors(spark, sf_dir).withColumns({"text": F.concat(F.lit("text of "), F.col("chunk_id").cast("string")), "source": F.concat(F.lit("f"), F.col("chunk_id").cast("string")), "page": F.lit(1), "section": F.lit(""), "file_type": F.lit("pdf")})
    return answer_question(chunks, "which text?", probe_of(spark, sf_dir), DEFAULTS).as_frame(spark)


# -- hybrid ---------------------------------------------------------------------------------------

_BM25 = """WITH t AS (SELECT doc_id AS chunk_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> ''] AS ts FROM documents), c AS (SELECT chunk_id, len(ts) AS dl, len([x FOR x IN ts IF x = 'thea']) AS f0, len([x FOR x IN ts IF x = 'oner']) AS f1 FROM t),
w AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c),
s AS (SELECT chunk_id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.5 / (f0 + 1.5 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.5 / (f1 + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS score FROM c, w WHERE f0 > 0 OR f1 > 0),
b AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20)"""


def _keyword(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return hybrid.bm25(d, ["thea", "oner"], 20)


@query(f"""{_BM25} SELECT chunk_id, round(score, 6) AS score, rank::INT AS rank FROM b""")
def bm25_topk(spark, sf_dir):
    return _keyword(spark, sf_dir).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""{_BM25}, v AS (SELECT vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings), k AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM v QUALIFY rank <= 20),
u AS (SELECT chunk_id, rank FROM b UNION ALL SELECT chunk_id, rank FROM k), g AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM u GROUP BY chunk_id)
SELECT chunk_id, round(rrf, 6) AS rrf, rank::INT AS rank FROM (SELECT chunk_id, rrf, row_number() OVER (ORDER BY rrf DESC, chunk_id) AS rank FROM g) WHERE rank <= 10""")
def rrf_fusion(spark, sf_dir):
    near = retrieval.top_hits(_vectors(spark, sf_dir), probe_of(spark, sf_dir), top_k=20, min_score=-1.0)
    return hybrid.fused([_keyword(spark, sf_dir), near], 10).select("chunk_id", F.round("rrf", 6).alias("rrf"), "rank")


@query(f"""{_VEC}, k AS (SELECT q.vec_id AS qid, q.label AS grp, v.label = q.label AS relevant, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id) AS rank FROM v, v q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 6),
e AS (SELECT grp, qid, max(relevant::INT) AS hit, min(rank) FILTER (relevant) AS first FROM k GROUP BY grp, qid) SELECT grp, count(*) AS n_queries, round(avg(hit), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM e GROUP BY grp""")
def recall_mrr(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    probes = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("probe"))
    hits = retrieval.top_hits_of_each(v, probes, 7).where("qid <> chunk_id")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("rank <= 6")
    asked = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), F.col("label").alias("grp"))
    labelled = hits.join(v.select("chunk_id", F.col("label").alias("l")), "chunk_id").join(asked, "qid")
    return hybrid.measures(labelled.select("grp", "qid", "rank", (F.col("l") == F.col("grp")).alias("relevant")), "grp").select("grp", "n_queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query("""SELECT count(*) AS n_docs, round(avg((len([x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> '']) > 512)::INT), 6) AS share_over FROM documents""")
def token_window_share(spark, sf_dir):
    n = F.size(hybrid.terms(F.col("text")))
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg((n > 512).cast("int")), 6).alias("share_over"))
