"""Cosine retrieval, contexts, citations and answers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestar.functions import nearest, vectors
from lodestar.functions.text import ustrip

#: Types cited by sheet name.
SHEET_TYPES = ("xlsx", "xlsm", "xls", "csv")
#: Probes that are broadcast at a time.
PROBE_BLOCK = 10_000
#: Pairs of chunks and probes for a task.
TASK_PAIRS = 250_000_000


def pool_size(top_k: int, factor: int = 4, cap: int = 100) -> int:
    return min(max(factor * top_k, top_k), cap)


def top_hits(chunks: DataFrame, probe: list[float], top_k: int | None = None, min_score: float | None = None, contains: str | None = None, default_k: int = 6, default_floor: float = 0.0, key: str = "chunk_id") -> DataFrame:
    """The best chunks by cosine, ``rank`` from 1: filter by substring, take the pool, drop those under the floor, take k.

    Ties go by key. The order and limit become one TakeOrderedAndProject, so
    only a pool from each task travels.
    """
    k = top_k or default_k
    floor = default_floor if min_score is None else min_score
    rows = chunks.where(F.col("text").contains(contains)) if contains else chunks
    score = vectors.cosine(F.col("embedding"), F.lit([float(x) for x in probe]))
    pool = rows.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(pool_size(k))
    ranked = pool.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # at most a pool of rows
    return ranked.where(F.col("rank") <= k)


def top_hits_of_each(chunks: DataFrame, probes: DataFrame, top_k: int, key: str = "chunk_id") -> DataFrame:
    """qid, key, score, rank for many probes (qid, probe), by score, then key.

    The probes are a stated query set: blocks of PROBE_BLOCK of them, one after the
    other, are gathered and broadcast to every chunk. A task multiplies its chunks
    with a block and holds the best of each probe, so what is shuffled is top_k rows
    of each probe and task, and memory is bounded by the sizes of a block and a batch.
    Null, empty and zero vectors, those with a null and those of another length than
    the probe have no score and are left out.
    """
    asked = probes.select("qid", F.col("probe").alias("q")).where("q IS NOT NULL")
    unit = chunks.select(key, F.col("embedding").alias("e")).where("e IS NOT NULL")
    n = asked.count()
    blocks = max(1, -(-n // PROBE_BLOCK))
    tasks, slots = unit.count() * min(n, PROBE_BLOCK) // TASK_PAIRS + 1, chunks.sparkSession.sparkContext.defaultParallelism
    if tasks > slots:
        tasks = -(-tasks // slots) * slots  # no core waits for the last ones
    if tasks > 1:
        unit = unit.repartition(tasks, key)
    scored = reduce(DataFrame.unionByName, [_scored(unit, asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i), top_k) for i in range(blocks)])
    by = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)


def _scored(unit: DataFrame, asked: DataFrame, top_k: int) -> DataFrame:
    """qid, key, score: the best of each task for a block of probes (qid, q)."""
    block = asked.toArrow()
    shared = unit.sparkSession.sparkContext.broadcast(tuple(block[c].combine_chunks() for c in ("qid", "q")))
    qid, key = asked.schema["qid"], unit.schema[0]
    schema = StructType([StructField("qid", qid.dataType), StructField(key.name, key.dataType), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in nearest.nearest(batches, *shared.value, top_k):
            yield pa.record_batch(list(found), names=schema.names)

    return unit.mapInArrow(run, schema)


def citation(source: Column, page: Column, section: Column, file_type: Column) -> Column:
    section = F.coalesce(section, F.lit(""))
    return (
        F.when(page > 0, F.concat(source, F.lit(", p."), page.cast("string")))
        .when((section != "") & file_type.isin(*SHEET_TYPES), F.concat(source, F.lit(', sheet "'), section, F.lit('"')))
        .when(section != "", F.concat(source, F.lit(", "), section))
        .otherwise(source)
    )


def hit_columns(rows: DataFrame) -> DataFrame:
    """Defaults of incomplete rows: text '', page -1, section '', chunk 0; score from distance."""
    return rows.withColumns({
        "text": F.coalesce("text", F.lit("")),
        "page": F.coalesce(F.col("page").try_cast("int"), F.lit(-1)),
        "section": F.coalesce("section", F.lit("")),
        "chunk": F.coalesce(F.col("chunk").try_cast("int"), F.lit(0)),
        "score": 1 - F.col("distance"),
    })


def context_blocks(hits: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """by, rank, block, clipped: the blocks that fit into ``most`` characters; hits have rank, cite and text.

    A block that would exceed the rest ends the context; the first one is clipped
    instead. Two characters between blocks count.
    """
    group = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    full = hits.withColumn("block", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("cite"), F.lit("\n"), ustrip(F.col("text"))))
    used = F.coalesce(F.sum(F.least(F.char_length("block"), F.lit(most)) + 2).over(group.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = full.withColumn("used", used).where((F.col("used") == 0) | (F.col("used") + F.char_length("block") <= most))
    return kept.select(*([by] if by else []), "rank", F.left("block", F.lit(most)).alias("block"), (F.char_length("block") > most).alias("clipped"))


def contexts(hits: DataFrame, most: int, by: str) -> DataFrame:
    """by, context, n_blocks, truncated."""
    blocks = context_blocks(hits, most, by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"), F.max("clipped").alias("clipped"))
    given = hits.groupBy(by).agg(F.count(F.lit(1)).alias("given"))
    return blocks.join(given, by).select(by, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"), F.size("b").alias("n_blocks"), (F.col("clipped") | (F.size("b") < F.col("given"))).alias("truncated"))


def user_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Excerpts:\n\n"), context, F.lit("\n\nQuestion: "), question)


def cited_ranks(answer: Column) -> Column:
    """Sorted distinct numbers of the [n] markers of one to three digits."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))))


def validated(answers: DataFrame) -> DataFrame:
    """answers (answer, ranks) with cited, unknown and warning ('' if all is well)."""
    out = answers.withColumn("used", cited_ranks(F.col("answer")))
    out = out.withColumns({"cited": F.array_intersect("used", "ranks"), "unknown": F.array_except("used", "ranks")})
    listed = F.array_join(F.transform("unknown", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", ")
    warning = F.when(F.size("unknown") > 0, F.concat(F.lit("answer cites excerpt(s) that were not provided: "), listed)).when((F.size("used") == 0) & (ustrip(F.coalesce("answer", F.lit(""))) != ""), "answer contains no [n] citations").otherwise("")
    return out.withColumn("warning", warning).drop("used")


def snippet(text: Column, most: int = 600) -> Column:
    """White space collapsed; longer ones are cut, right-stripped and end in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.rtrim(F.left(flat, F.lit(most))), F.lit("…"))).otherwise(flat)


def extractive_answer(hits: DataFrame, by: str, most: int = 600) -> DataFrame:
    """by, answer: the cited excerpts themselves."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("cite"), F.lit("\n"), snippet(F.col("text"), most))
    return hits.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("answer"))
