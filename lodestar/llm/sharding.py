"""Random sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded
hash. Pass 2 shuffles each bucket with Fisher-Yates, seeded by seed and bucket,
and writes it. The buckets' row counts then give every record its place in the
shuffled whole, and the places are dealt to the shards in turn: law `rows`, so
shard sizes differ by one row at most, whatever the keys look like.

The scatter hash takes the row's place in the input beside its id, so equal
rows, null ids and hot ids spread like all others. With the same input files
and split sizes the order is the same for the same seed. Null text has no bytes.
An empty table gives no rows. Other columns of the input are kept as they are;
an input column that clashes with an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import lean, numbered, parts, pick, place_of, scratch, written

#: Text bytes a bucket holds on average; a bucket must fit in a task's memory.
BUCKET_BYTES = 24 << 20
#: Up to so many buckets their offsets are broadcast (24 TB of text); beyond that they are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000


def scattered(docs: DataFrame, seed: int, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The records with their bucket and place in it, written to the shared folder."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64)).first()[0] or 0
    buckets = parts(size, bucket_bytes)
    keyed = docs.withColumn("__scatter", F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bucket = TaskContext.get().partitionId()
        # rows arrive in any order; Fisher-Yates starts from the order of their hashes
        order = pc.sort_indices(table, sort_keys=[("__scatter", "ascending")]).to_numpy().copy()
        np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
        for at in range(0, len(order), 1000):
            out = table.take(pa.array(order[at : at + 1000])).drop_columns(["__scatter"]).combine_chunks()
            out = out.append_column("__bucket", pa.array(np.full(out.num_rows, bucket, np.int32))).append_column("__at", pa.array(np.arange(at, at + out.num_rows, dtype=np.int64)))
            yield from out.to_batches()

    schema = docs.withColumns({"__bucket": F.lit(0), "__at": F.lit(0).cast("long")}).schema
    return written(keyed.repartition(buckets, "__scatter").mapInArrow(lean(run), schema), scratch(docs.sparkSession, "buckets"))


def shard(docs: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The records in random order: columns of the input, shard (int) and slot (long, gapless from 0)."""
    names = docs.columns
    keep = [i for i, n in enumerate(names) if n.lower() not in ("shard", "slot")]
    own = numbered(docs).select(*[f"c{i}" for i in keep])
    mixed = scattered(own, seed, bucket_bytes, f"c{place_of(names, id_col)}", f"c{place_of(names, text_col)}")
    counts = sorted((r["__bucket"], r["n"]) for r in mixed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).collect())  # a number for each bucket
    starts, total = [], 0
    for bucket, n in counts:
        starts.append((bucket, total))
        total += n
    offsets = docs.sparkSession.createDataFrame(starts, "__bucket int, __start long")
    if len(starts) <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)  # 12 bytes a bucket, so the texts stay where they are
    place = F.col("__start") + F.col("__at")
    placed = mixed.join(offsets, "__bucket").select(*own.columns, F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))
    return placed.toDF(*[names[i] for i in keep], "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order over its files."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digests(sharded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = pick(sharded, doc_id=id_col, text=text_col, shard="shard", slot="slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    return own.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
