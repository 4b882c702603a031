"""SimHash near-duplicate groups: BK-trees over shards of fingerprints.

Fingerprint: words (lower-cased A to Z), shingles of some words with repeats,
XXH64 of each; a bit is 1 if it is set in over half the hashes. Distinct
fingerprints link at a small Hamming distance; groups are the connected
components and a group's id is its smallest doc_id.

Shards. A 64-bit fingerprint is cut into ``blocks`` blocks. Two fingerprints that
differ in at most r bits agree in at least blocks - r whole blocks, so every
linked pair meets in the shard of some choice of blocks - r blocks and their
values. This is exact and each shard is small. A shard's fingerprints form a
BK-tree (children keyed by their integer Hamming distance to the parent) and
each of them is looked up by following only the edges within the radius. Trees
travel with their shard in the shuffle: broadcasting them would first gather the
fingerprints of the whole corpus on the driver. A shard with more than
``tree_rows`` fingerprints is cut again by blocks of its remaining bits, which is
exact by the same argument and bounds every tree and its queries.

Copies. Equal texts have equal fingerprints, so trees see each fingerprint once
and a group of copies costs one row. A shard answers with a spanning forest of
its links, never with all pairs; linked fingerprints are then joined into
components by alternating large-star and small-star steps, each written to the
shared folder.

Null and empty texts, and texts of spaces alone, have fingerprint zero and link
like any other; texts with fewer words than a shingle have one shingle, the
whole sequence. Rows with a null doc_id never name a group unless all its rows
have none (component null). Repeated rows count once. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import lean, pick, remove, scratch, written

SEED = 42
TREE_ROWS = 32_768


# -- fingerprints ---------------------------------------------------------------------------------


def voted(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096]
        count += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, words: int) -> int:
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(joined, SEED)
    start, starts = 0, []
    for w in found:
        starts.append(start)
        start += len(w) + 1
    starts.append(start)
    n = len(found) - words + 1
    return voted(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[words:], strict=False)), "<u8", n))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t, words) for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], _signed(fps)], names=["doc_id", "fp"])

    own = pick(docs, doc_id=id_col, text=text_col)
    return own.mapInArrow(lean(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp long")


# -- BK-trees -------------------------------------------------------------------------------------


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = np.bitwise_count(a ^ b)
    return differ.astype(np.int64) if differ.ndim == 1 else differ.sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over many groups at once: level by level, in whole arrays.

    ``fps`` are distinct within a group and ``group`` is non-decreasing; one that
    is longer than 64 bits is a row of several numbers. Every fingerprint is a
    node; ``root[g]`` is a group's first one. Children are stored by (parent,
    distance), so the edges within a radius are one slice.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps, n = fps, len(fps)
        self.bits = 64 if fps.ndim == 1 else 64 * fps.shape[1]
        self.up = np.full(n, -1)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(starts, np.diff(np.r_[starts, n])) if n else starts
        edges = []
        node = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        parent = self.root[node]
        while len(node):
            self.up[node] = parent
            key = parent * (self.bits + 1) + _distance(fps[node], fps[parent])
            order = np.argsort(key, kind="stable")
            node, key = node[order], key[order]
            first = np.r_[True, key[1:] != key[:-1]]
            child = node[first]
            edges.append((key[first], child))
            under = child[np.cumsum(first) - 1]
            node, parent = node[~first], under[~first]
        keys = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, np.int64)
        kids = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.kids = keys[order], kids[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int, block: int = 4096, left: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, node) of all nodes within the radius, in parts.

        left: how many nodes of every subtree are wanted; subtrees with none are passed over.
        """
        for at in range(0, len(queries), block):
            stack = [(np.arange(at, min(at + block, len(queries))), roots[at : at + block])]
            while stack:
                q, node = stack.pop()
                if left is not None:
                    some = left[node] > 0
                    q, node = q[some], node[some]
                if len(q) > 1 << 19:  # bounded memory: the two halves one after the other
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                distance = _distance(queries[q], self.fps[node])
                near = distance <= radius
                if near.any():
                    yield q[near], node[near]
                low = np.searchsorted(self.keys, node * (self.bits + 1) + np.maximum(distance - radius, 0))
                high = np.searchsorted(self.keys, node * (self.bits + 1) + np.minimum(distance + radius, self.bits), side="right")
                many = high - low
                total = int(many.sum())
                if total:
                    slot = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(total)
                    stack.append((np.repeat(q, many), self.kids[slot]))

    def families(self, radius: int) -> np.ndarray:
        """For every node a node of its component, by links within the radius.

        One component of each group grows at a time, by the queries of its last
        finds. What is found leaves the trees, so a family of copies, all near to
        its first member, takes one search and not one for each of its pairs.
        """
        n = len(self.fps)
        name, grown, left = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)

        def count(nodes: np.ndarray, by: int) -> None:
            while len(nodes):
                np.add.at(left, nodes, by)
                nodes = self.up[nodes]
                nodes = nodes[nodes >= 0]

        count(np.arange(n), 1)
        open_ = np.arange(n)
        while len(open_):
            new = open_[np.r_[True, self.root[open_][1:] != self.root[open_][:-1]]]  # the first of each group
            grown[self.root[new]] = new
            name[new] = new
            count(new, -1)
            while len(new):
                found = []
                for _, node in self.search(self.fps[new], self.root[new], radius, left=left):
                    node = np.unique(node[name[node] < 0])
                    name[node] = grown[self.root[node]]
                    count(node, -1)
                    found.append(node)
                new = np.concatenate(found) if found else new[:0]
            open_ = open_[name[open_] < 0]
        return name


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _links(shard: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in whole shards, which stand one after the other."""
    forest, union = Forest(fps, shard), Union(len(fps))
    for a, b in forest.search(fps, forest.root, radius):
        pairs = np.unique(np.minimum(a, b)[a != b] * len(fps) + np.maximum(a, b)[a != b])
        for x, y in zip((pairs // len(fps)).tolist(), (pairs % len(fps)).tolist(), strict=True):
            union.join(x, y)
    root = np.array([union.find(i) for i in range(len(fps))])
    joined = np.flatnonzero(root != np.arange(len(fps)))
    return joined, root[joined]


def block_masks(bits: list[int], blocks: int, radius: int) -> list[int]:
    """The masks of every choice of blocks - radius of the blocks that the bits are cut into."""
    edges = np.linspace(0, len(bits), blocks + 1).astype(int)
    masks = [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _masked(fp: Column, mask: Column) -> Column:
    return F.xxhash64(fp.bitwiseAND(mask))


def _literals(masks: list[int]) -> Column:
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])


def shards(fps: DataFrame, radius: int, blocks: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """node, fp, shard: every two fingerprints within the radius share a shard.

    A shard with more than ``tree_rows`` fingerprints is cut again by blocks of its
    remaining bits. With four blocks and a radius of two, 64 bits leave 32 and
    then 16 open, so a shard has at most 65,536 fingerprints whatever the input.
    """
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    masks = block_masks(list(range(64)), blocks, radius)
    inner = [block_masks([x for x in range(64) if not m >> x & 1], blocks, radius) for m in masks]
    keyed = fps.select("node", "fp", F.posexplode(_literals(masks)).alias("i", "m")).select("node", "fp", "i", "m", F.xxhash64("i", _masked(F.col("fp"), F.col("m"))).alias("shard"))
    large = written(keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_rows).select("shard", F.lit(True).alias("large")), scratch(fps.sparkSession, "large"))
    if large.isEmpty():
        return keyed.select("node", "fp", "shard")
    marked = keyed.join(large, "shard", "left")
    small = marked.where("large IS NULL").select("node", "fp", "shard")
    finer = F.get(F.array(*[_literals(x) for x in inner]), F.col("i"))
    again = marked.where("large").select("node", "fp", "shard", F.posexplode(finer).alias("j", "more"))
    return small.unionByName(again.select("node", "fp", F.xxhash64("shard", "j", _masked(F.col("fp"), F.col("more"))).alias("shard")))


def links(fps: DataFrame, radius: int, blocks: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """a, b: links between node numbers of fps (node, fp; distinct fp), at least a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_shards(batches):
            _, shard = np.unique(held["shard"].to_numpy(), return_inverse=True)
            a, b = _links(shard, held["fp"].to_numpy().view(np.uint64), radius)
            if len(a):
                node = held["node"].to_numpy()
                yield pa.record_batch([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return shards(fps, radius, blocks, tree_rows).repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(run), "a long, b long")


def _whole_shards(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.Table]:
    """Sorted batches gathered into tables that end with a shard's last row; shards of one row are left out."""
    held: list[pa.RecordBatch] = []
    count = 0

    def flush(table: pa.Table) -> Iterator[pa.Table]:
        s = table["shard"].to_numpy()
        if len(s) < 2:
            return
        same = s[1:] == s[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        if keep.any():
            yield table.filter(pa.array(keep)).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            s = table["shard"].to_numpy()
            last = int(np.searchsorted(s, s[-1]))
            if last:
                yield from flush(table.slice(0, last))
                rest = table.slice(last).combine_chunks()
                held = rest.to_batches()
                count = rest.num_rows
    if held:
        yield from flush(pa.Table.from_batches(held))


# -- components -----------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: every node of edges (a, b) with the smallest node of its component.

    Alternating large-star and small-star steps. Each is one shuffle of the
    remaining edges; their number is logarithmic in a component's diameter.
    """
    spark = edges.sparkSession
    path = scratch(spark, "edges")
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    for _ in range(rounds):
        if now.isEmpty():
            break
        # large star: every larger neighbour of a node links to the node's smallest one
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["v"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour of a node, and the node, link to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        small = large.join(least, large["a"] == least["v"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        fresh = scratch(spark, "edges")
        after = written(small, fresh)
        same = after.count() == now.count() and after.exceptAll(now).isEmpty()
        remove(spark, path)
        now, path = after, fresh
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = 4, id_col: str = "doc_id", text_col: str = "text", tree_rows: int = TREE_ROWS) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    spark = docs.sparkSession
    prints = written(fingerprints(docs, words, id_col, text_col), scratch(spark, "fingerprints"))
    # a fingerprint is its own node number: an id may have several
    distinct = prints.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("least"))
    nodes = written(distinct.withColumn("node", F.col("fp")), scratch(spark, "nodes"))
    joined = components(links(nodes, radius, blocks, tree_rows=tree_rows))
    members = nodes.join(joined, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    members = written(members, scratch(spark, "members"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(written(members.join(least, "root").select("fp", "component_id"), scratch(spark, "named")), "fp")


def hex64(fp):
    """A signed long's 64 bits as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
