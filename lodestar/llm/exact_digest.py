"""Canonical exact digests of documents, in DataFrame operations alone.

Canonical form: Unicode compatibility composition (NFKC), full case folding,
NFKC again (folding may undo it), every run of white space one space, none at
the ends. Fingerprint: four XXH64 over the canonical bytes, each after another
salt, as 64 hex digits. Documents are grouped by it and, inside a bucket of equal
fingerprints, by comparison of the canonical bytes: texts that share a bucket
but not their bytes get suffixes "-1", "-2", ... in the order of their bytes.

Normalisation and folding are those of ICU, which Spark ships, called through
the SQL function `reflect`.

Neighbours. The next document by descending id, after the last one the first, is
found without gathering rows in one task and with one shuffle of the texts: they
are dealt to ranges of ids and written as a table bucketed by the range, so a
window per range reads them in place; the first text of every range joins the
range before it. Rows of equal id follow each other by their texts.

Comparison. A bitmap of fixed size over the repeated digests is broadcast; rows
that hit it are canonicalised a second time, in place, and their distinct pairs
of digest and bytes are counted. Pairs are made distinct in every task before
they are dealt, by digest and bytes, so a text with a third of all rows as
copies is sent once by each task. A digest with two texts is mixed.

Defined results: null text counts as empty; rows with a null id have no next
document (empty next text, near_next 0); a single document is its own next;
an empty table gives no rows. Likeness of two exact digests is 1 or 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import freed_shuffles, goes_at_exit, joined_in_place, parts, pick, scratch, text_bytes, written

#: Text bytes of a range of ids, on average, and buckets of a table's files.
RANGE_BYTES = 16 << 20
MOST_FILES = 8192
#: Bits of the map of repeated digests that is broadcast: 8 MB whatever the input.
FILTER_BITS = 1 << 26
SALTS = (0, 1, 2, 3)


def canonical(text: Column) -> Column:
    icu, folder = F.lit("com.ibm.icu.text.Normalizer"), F.lit("com.ibm.icu.lang.UCharacter")

    def composed(x: Column) -> Column:
        return F.reflect(icu, F.lit("compose"), x, F.lit(True))

    folded = composed(F.reflect(folder, F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_digest(canon: Column, salts: tuple[int, ...] = SALTS) -> Column:
    return F.concat(F.lit(""), *[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(s), canon))), 16, "0") for s in salts])


def in_ranges(rows: DataFrame, by: str, buckets: int) -> DataFrame:
    """rows as a table in the shared folder that Spark knows to be dealt by a column: windows and joins on it shuffle nothing."""
    spark, path, name = rows.sparkSession, scratch(rows.sparkSession, "ranges"), f"ranges_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        rows.write.format("parquet").bucketBy(min(buckets, MOST_FILES), by).option("compression", "zstd").option("path", path).saveAsTable(name)
    goes_at_exit(spark, path)
    found = spark.table(name)
    found.schema  # noqa: B018 - resolved now: the name goes, the files stay
    spark.sql(f"DROP TABLE {name}")
    return found


def repeated_map(digests: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """w, m: the 64-bit words of a bitmap over the digests that come more than once. At most bits / 64 rows."""
    often = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = F.pmod(F.xxhash64("digest"), F.lit(bits))
    words = often.select(F.shiftrightunsigned(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    return written(words, scratch(digests.sparkSession, "repeated"))


def hits(rows: DataFrame, digest: str, as_name: str, words: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """rows with a flag: the digest is on the map. All that come twice are, and hardly any other."""
    place = F.pmod(F.xxhash64(digest), F.lit(bits))
    found = rows.withColumn("__w", F.shiftrightunsigned(place, 6)).join(F.broadcast(words.select(F.col("w").alias("__w"), F.col("m").alias("__m"))), "__w", "left")
    return found.withColumn(as_name, F.coalesce(F.call_function("shiftright", F.col("__m"), (place % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))).drop("__w", "__m")


def impure_buckets(rows: DataFrame) -> DataFrame:
    """digest, canon -> suffix, for buckets of rows (digest, canon) that hold several canonical texts."""
    texts = rows.select("digest", "canon").distinct()
    mixed = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    if (found := written(mixed, scratch(rows.sparkSession, "impure"))).isEmpty():  # as good as always
        return rows.sparkSession.createDataFrame([], "digest string, canon string, suffix int")
    return texts.join(found, "digest", "left_semi").withColumn("suffix", F.row_number().over(Window.partitionBy("digest").orderBy("canon")))


def _ranged(rows: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """rows (doc_id, text) as a table with p (a range of descending ids), o (ascending where ids descend) and k (the row's number); and the ranges."""
    n, size = text_bytes(rows)
    ranges = parts(size + 16 * n, range_bytes)
    known = rows.where("doc_id IS NOT NULL").withColumn("o", F.bitwise_not(F.col("doc_id").cast("long")))
    known = known.repartitionByRange(ranges, "o").withColumn("p", F.spark_partition_id())
    blank = rows.where("doc_id IS NULL").select("*", F.lit(None).cast("long").alias("o"), (-1 - F.pmod(F.monotonically_increasing_id(), F.lit(ranges))).cast("int").alias("p"))
    return in_ranges(known.unionByName(blank).withColumn("k", F.monotonically_increasing_id()), "p", ranges), ranges


def with_next(table: DataFrame) -> DataFrame:
    """The table of _ranged with next_text (null where there is none)."""
    first = table.where("p >= 0").groupBy("p").agg(F.min(F.struct("o", "text")).alias("head"))
    first = written(first.select("p", F.col("head.text").alias("head")), scratch(table.sparkSession, "heads"))  # a text for each range
    order = first.select("p")
    top = order.agg(F.min("p").alias("top"))
    after = order.select("p", F.lead("p").over(Window.orderBy("p")).alias("q")).join(F.broadcast(top)).select(F.col("p").alias("at"), F.coalesce("q", "top").alias("q"))  # numbers of ranges alone
    follows = after.join(first, F.col("q") == F.col("p")).select(F.col("at").alias("p"), "head")
    inside = F.lead("text").over(Window.partitionBy("p").orderBy("o", "text"))
    return table.withColumn("inside", inside).join(follows, "p", "left").withColumn("next_text", F.when(F.col("doc_id").isNotNull(), F.coalesce("inside", "head"))).drop("inside", "head")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many first characters of the following one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def _rows_of(table: DataFrame) -> DataFrame:
    """The table with edit (the edited text) and an empty next text where there is none."""
    rows = with_next(table).select("p", "k", "doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"), F.col("next_text").isNotNull().alias("has_next"))
    return rows.withColumn("edit", edited(F.col("text"), F.col("next_text")))


def fingerprints(docs: DataFrame, salts: tuple[int, ...] = SALTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and group_id (the smallest doc_id with the same canonical text) of documents."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("digest", wide_digest(F.col("canon"), salts))
    words = repeated_map(rows.select("digest"))
    mixed = written(impure_buckets(hits(rows, "digest", "twice", words).where("twice")), scratch(spark, "impure"))
    if mixed.isEmpty():
        found = written(rows.select("doc_id", F.col("digest").alias("fingerprint")), scratch(spark, "digests"))
    else:
        told = rows.join(mixed, ["digest", "canon"], "left").select("doc_id", F.concat("digest", F.coalesce(F.concat(F.lit("-"), "suffix"), F.lit(""))).alias("fingerprint"))
        found = written(told, scratch(spark, "digests"))
    return found.join(found.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id")), "fingerprint")


def fingerprint_edits(docs: DataFrame, salts: tuple[int, ...] = SALTS, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The texts are shuffled once, into ranges of ids that are written; digests are
    written beside them, dealt alike, and the byte comparison reads both in place.
    """
    spark = docs.sparkSession
    own = pick(docs, doc_id=id_col, text=text_col)
    table, ranges = _ranged(own.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), range_bytes)
    rows = _rows_of(table).select("*", canonical(F.col("text")).alias("canon"), canonical(F.col("edit")).alias("edit_canon"), canonical(F.col("next_text")).alias("next_canon"))
    narrow = rows.select(
        "p",
        "k",
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edit", 256).alias("edited_sha256"),
        wide_digest(F.col("canon"), salts).alias("digest"),
        wide_digest(F.col("edit_canon"), salts).alias("edit_digest"),
        (F.col("canon") == F.col("edit_canon")).cast("double").alias("near_edited"),
        (F.col("has_next") & (F.col("canon") == F.col("next_canon"))).cast("double").alias("near_next"),
    )
    narrow = in_ranges(narrow, "p", ranges)
    words = repeated_map(narrow.select("digest").unionAll(narrow.select(F.col("edit_digest").alias("digest"))))
    flags = hits(hits(narrow.select("p", "k", "digest", "edit_digest"), "digest", "twice", words), "edit_digest", "edit_twice", words)
    again = _rows_of(table).select("p", "k", "text", "edit").join(flags.where("twice OR edit_twice"), ["p", "k"])

    def side(twice: str, digest: str, text: str, edit: bool) -> Column:
        return F.when(F.col(twice), F.struct(F.col(digest).alias("digest"), F.col(text).alias("text"), F.lit(edit).alias("edited")))

    sides = F.filter(F.array(side("twice", "digest", "text", False), side("edit_twice", "edit_digest", "edit", True)), lambda x: x.isNotNull())
    shared = again.select("k", F.explode(sides).alias("s")).select("k", "s.digest", "s.edited", canonical(F.col("s.text")).alias("canon"))
    with joined_in_place(spark):
        mixed = written(impure_buckets(shared), scratch(spark, "impure"))
        alike = mixed.isEmpty()
        told = None if alike else written(shared.join(mixed, ["digest", "canon"]).select("k", "edited", F.concat(F.lit("-"), "suffix").alias("s")), scratch(spark, "told"))
    if not alike:
        for edit, name in ((False, "digest"), (True, "edit_digest")):
            narrow = narrow.join(told.where(F.col("edited") == edit).select("k", "s"), "k", "left").withColumn(name, F.concat(name, F.coalesce("s", F.lit("")))).drop("s")
    return narrow.select("doc_id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edit_digest").alias("edited_fingerprint"), "near_edited", "near_next")
