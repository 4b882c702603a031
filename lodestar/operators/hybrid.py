"""Keyword ranking, rank fusion and retrieval measures."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


_PART = r"[\p{L}\p{N}]"


def _occurrences(text: Column, word: str) -> Column:
    """How often a lower-cased text has a word among its terms. Texts without its letters aren't searched."""
    alone = F.lit(f"(?<!{_PART}){re.escape(word)}(?!{_PART})")
    return F.when(text.contains(word), F.regexp_count(text, alone)).otherwise(0)


def bm25(chunks: DataFrame, query_terms: list[str], top_k: int, k1: float = 1.5, b: float = 0.75, key: str = "chunk_id") -> DataFrame:
    """key, score, rank of the best chunks for some words; none without words.

    Only the asked words are counted, inside each row, so nothing is split or
    exploded: one pass for document frequencies and the mean length, and one over
    the rows that hold a word, for the scores.
    """
    words = [w for w in dict.fromkeys(w.lower() for w in query_terms) if w]
    low = chunks.select(key, F.lower("text").alias("low"))
    if not words:
        return low.select(key, F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    counts = [_occurrences(F.col("low"), w).alias(f"tf_{i}") for i, w in enumerate(words)]
    length = F.regexp_count("low", F.lit(f"{_PART}+")).alias("dl")
    whole = low.select(length, *counts).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(words))])
    may = reduce(lambda x, y: x | y, [F.col("low").contains(w) for w in words])
    scored = low.where(may).select(key, length, *counts).where(" OR ".join(f"tf_{i} > 0" for i in range(len(words)))).join(F.broadcast(whole), F.lit(True))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    top = scored.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fused(lists: list[DataFrame], top_k: int, constant: int = 60, key: str = "chunk_id", chunks: DataFrame | None = None, contains: str | None = None) -> DataFrame:
    """key, rrf, rank: the sum of 1 / (constant + rank) over ranked lists (key, rank).

    contains: of the fused list only chunks (key, text) with this substring stay.
    """
    both = lists[0].select(key, "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select(key, "rank"))
    if contains and chunks is not None:
        both = both.join(chunks.where(F.col("text").contains(contains)).select(key), key, "left_semi")
    top = both.groupBy(key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("rrf")).orderBy(F.desc("rrf"), key).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rrf"), key)))


def measures(hits: DataFrame, group: str) -> DataFrame:
    """group, n_queries, recall (a relevant hit among those given), mrr. hits: qid, rank, relevant."""
    each = hits.groupBy(group, "qid").agg(F.max(F.col("relevant").cast("int")).alias("hit"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return each.groupBy(group).agg(F.count(F.lit(1)).alias("n_queries"), F.avg("hit").alias("recall"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def prefixed(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text)
