"""Sequence packing by best fit, longest pieces first.

Every document's ids (an end id added) are first cut into full windows, which
are sequences of their own. What remains of each document, shorter than a
window, is packed: longest first, each into the open window whose remaining
capacity is the smallest that still holds it. A segment tree indexed by
remaining capacity finds that window in logarithmic time.

Remainders are dealt by a hash of their numbers into groups of about
``group_rows`` and each group is packed by one task, which sees numbers and
lengths and no ids. The groups' number grows with the input while a task's
memory does not. Padding is the open rest of each group's last windows: under a
hundredth of the tokens (tested).

Null text counts as empty: its one token is the end id. Ties between equal
lengths go by doc_id, start and the piece's number, so the result doesn't depend
on arrival order. Repeated rows are packed once each and spread over the groups.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import lean, parts, pick, scratch, trim, written
from lodestar.llm.token_counts import library, packed

GROUP_ROWS = 40_000


class CapacityTree:
    """Open windows by remaining capacity; finds the least capacity of at least a size that any window has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, window: int) -> None:
        self.open[remaining].append(window)
        i = self.leaves + remaining
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest window for size and its remaining capacity, taken out; None if none holds it."""
        count, i = self.count, self.leaves + size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right neighbour holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        remaining = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return remaining, self.open[remaining].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset for each of the lengths, which come longest first."""
    tree, windows, offsets, opened = CapacityTree(capacity), [], [], 0
    for size in lengths:
        found = tree.take(size)
        if found is None:
            found = capacity, opened
            opened += 1
        remaining, window = found
        windows.append(window)
        offsets.append(capacity - remaining)
        if remaining > size:
            tree.add(remaining - size, window)
    return windows, offsets


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, ids_crc32 and (if asked for) ids: each document's ids cut into full windows and a remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, end, width = library(tokenizer), packed([end_id]), 4 * capacity
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                texts = [t or "" for t in part["text"].to_pylist()]
                row, start, total, cut = [], [], [], []
                for i, own in enumerate(lib.ids(texts)):
                    all_ids = own + end
                    for at in range(0, len(all_ids), width):
                        row.append(i)
                        start.append(at // 4)
                        total.append(len(all_ids) // 4)
                        cut.append(all_ids[at : at + width])
                made = [part["doc_id"].take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in cut], pa.int64()), pa.array(total, pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                yield pa.record_batch([*made, *([pa.array(cut, pa.binary())] if ids else [])], names=names)
        trim()

    own = pick(docs, doc_id=id_col, text=text_col)
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", *(["ids"] if ids else [])]
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids_crc32 long" + (", ids binary" if ids else ""))


def place(pieces: DataFrame, capacity: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces (piece, doc_id, start, length, ...: a table) with sequence_id and offset, by best fit. Columns as they are; keep them narrow.

    Ids are unique over all sequences; even ones are full windows, odd ones packed.
    """
    full = pieces.where(F.col("length") == capacity).select("*", (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    groups = parts(rest.count(), group_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        order = pc.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("piece", "ascending")])
        lengths = table["length"].take(order).to_pylist()
        windows, offsets = best_fit(lengths, capacity)
        base = TaskContext.get().partitionId() << 32
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        sequence[order.to_numpy()] = (np.asarray(windows, np.int64) + base) * 2 + 1
        offset[order.to_numpy()] = offsets
        yield from table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches(max_chunksize=10_000)

    return full.unionByName(rest.repartition(groups, F.xxhash64("piece")).mapInArrow(lean(run, library.__module__), full.schema))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group_rows: int = GROUP_ROWS, ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of token_pieces with piece (a number of its own for each), sequence_id and offset (the place in the sequence).

    The pieces are written once with their numbers. Only numbers and lengths are
    packed; with ``ids`` the ids join the result by the piece's number.
    """
    made = token_pieces(docs, tokenizer, capacity, end_id, ids, id_col, text_col).withColumn("piece", F.monotonically_increasing_id())
    pieces = written(made, scratch(docs.sparkSession, "pieces"))
    placed = place(pieces.drop("ids"), capacity, group_rows)
    return placed.join(pieces.select("piece", "ids"), "piece") if ids else placed


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence, its pieces in the order of their offsets."""
    one = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    return packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.array_join(F.transform(one, lambda x: x["hex"]), "")).alias("ids"))


def piece_digests(packed_pieces: DataFrame) -> DataFrame:
    return packed_pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
