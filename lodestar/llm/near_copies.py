"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

Candidates. A text's shingles (``words`` words, lower-cased A to Z; shorter texts
have one, the whole sequence; texts without words have one of their own) are
hashed with XXH3-64. The text's fingerprint is the SimHash of the distinct ones,
128 bits. Candidates are the fingerprints that BK-trees over shards link within
``RADIUS`` bits. A bit differs with probability 0.1875 at most in two sets with a
similarity of 0.8 or more (five shingles against four; 0.15 in large sets), so
such a pair is beyond the radius with probability 2e-7 at most (2e-10 in large sets).

Shards. So wide a radius leaves no bits of a fingerprint that must agree, as the
blocks of ``simhash`` do for two bits. So bands of the shingles name the shards: 128
multiply-shift functions each keep their smallest value, and texts that agree in
one of 32 bands of four values share a shard. Sets with similarity s miss each
other in all bands with probability (1 - s^4)^32: 5e-8 at 0.8, whatever edit made
the difference. Shards with the same members are handled once.

Links. The shingle sets of the candidates are joined to their groups and compared:
a link is a pair whose sets' Jaccard similarity is at least 0.8 in whole numbers.
Members that links have joined already aren't compared again, so a group of
copies takes few comparisons, and none is left out that could join two groups.
Large groups are compared with a representative first, and only what that leaves
open meets the whole group, block by block.

Nodes are distinct texts, named by the hash of the text: a group of exact copies
costs one row, and rows that share an id but not the text stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import lean, pick, recorded, remove, scratch, written
from lodestar.llm.simhash import SEED, Forest, _whole_shards, components, voted

BANDS, BAND_ROWS = 32, 4
#: Of 128 bits: five deviations above the largest mean at similarity 0.8.
RADIUS = 48
#: Members of a group that are compared at a time.
GROUP_ROWS = 1000
#: A band's shard with more texts is a group as it is, not thinned out by a task.
SHARD_ROWS = 50_000
#: Up to so many large shards their names are broadcast.
BROADCAST_SHARDS = 100_000
#: Up to so many bytes of representatives are broadcast.
BROADCAST_BYTES = 16 << 20
#: Stands for a missing id: the largest there is.
NO_ID = (1 << 63) - 1

_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(1 << 32, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(1, np.uint64)
    joined, starts, start = b" ".join(found), [], 0
    for w in found:
        starts.append(start)
        start += len(w) + 1
    starts.append(start)
    width = min(words, len(found))
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:], strict=False)), "<u8", len(found) - width + 1))


def min_values(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(_TIMES), (1 << 64) - 1, np.uint64)
    low = hashes >> np.uint64(32)
    for at in range(0, len(low), 512):
        np.minimum(least, (low[at : at + 512, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return least >> np.uint64(32)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """The SimHash of the shingles, 128 bits: the bits of the hashes, then those of the hashes mixed once more."""
    mixed = hashes ^ hashes >> np.uint64(31)
    for times in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        mixed = mixed * np.uint64(times)
        mixed ^= mixed >> np.uint64(29)
    return voted(hashes), voted(mixed)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the bands, and the fingerprint in two numbers."""
    raw = min_values(hashes).astype("<u4").reshape(BANDS, BAND_ROWS)
    bands = np.array([xxhash.xxh3_64_intdigest(row.tobytes(), i) for i, row in enumerate(raw)], np.uint64)
    return bands, np.array(fingerprint(hashes), np.uint64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """node, shards (one for each band), s1 and s2 of every row of docs (node, text). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(shingle_hashes(t, words)) for t in batch["text"].to_pylist()]
            if not made:
                continue
            bands = np.concatenate([m[0] for m in made]).view(np.int64)
            bits = np.stack([m[1] for m in made]).view(np.int64)
            shards = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)), pa.array(bands))
            yield pa.record_batch([batch["node"], batch["key"], shards, pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())], names=["node", "key", "shards", "s1", "s2"])

    return docs.mapInArrow(lean(run), "node long, key long, shards array<long>, s1 long, s2 long")


def families(shard: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Numbers of the components that the fingerprints (rows of two numbers) within the radius form in each shard."""
    order = np.lexsort((prints[:, 1], prints[:, 0], shard))
    s, p = shard[order], prints[order]
    fresh = np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1]).any(axis=1)]  # a tree has a fingerprint once
    found = Forest(p[fresh], s[fresh]).families(radius)
    out = np.empty(len(shard), np.int64)
    out[order] = found[np.cumsum(fresh) - 1]
    return out


def candidates(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """g, node: groups of nodes that may be near copies of each other. Every pair that shares a band and whose fingerprints are within the radius is in a group."""
    spark = prints.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_shards(batches):
            shard, node = held["shard"].to_numpy(), held["node"].to_numpy()
            bits = np.stack([held[c].to_numpy().view(np.uint64) for c in ("s1", "s2")], axis=1)
            family = families(shard, bits, radius)
            order = np.argsort(family, kind="stable")
            family, node = family[order], node[order]
            starts = np.flatnonzero(np.r_[True, family[1:] != family[:-1]])
            size = np.diff(np.r_[starts, len(node)])
            g = np.repeat(np.add.reduceat(node, starts), size)  # the sum names the set of members: nodes are hashes
            some = np.repeat(size > 1, size)
            yield pa.record_batch([pa.array(g[some]), pa.array(node[some])], names=["g", "node"])

    rows = prints.select(F.explode("shards").alias("shard"), "node", "s1", "s2")
    large = written(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).select("shard"), scratch(spark, "large"))
    n_large = large.count()
    whole = None
    if n_large:
        large = F.broadcast(large) if n_large <= BROADCAST_SHARDS else large
        whole = rows.join(large, "shard", "left_semi").select(F.col("shard").alias("g"), "node")
        rows = rows.join(large, "shard", "left_anti")
    found = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(run), "g long, node long")
    return (found if whole is None else found.unionByName(whole)).distinct()


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node and hashes (the distinct shingles', packed) of every row of docs (node, text). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes = batch["text"], batch["node"]
            for at in range(0, batch.num_rows, 256):
                packed = [shingle_hashes(t, words).tobytes() for t in texts[at : at + 256].to_pylist()]
                yield pa.record_batch([nodes[at : at + 256], pa.array(packed, pa.binary())], names=["node", "hashes"])

    return docs.select("node", "text").mapInArrow(lean(run), "node long, hashes binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b))  # shared / (a + b - shared) >= 4 / 5


def _linked(sets: list[np.ndarray], settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs with a Jaccard similarity of 0.8 or more. Pairs that are joined already aren't compared.

    settled: sets that are known to be joined with each other.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    _, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    start = np.r_[0, np.cumsum(size)]
    reach = np.searchsorted(size * 4, size * 5, side="right")  # larger sets have a similarity below 0.8
    root = np.arange(len(sets))
    known = np.flatnonzero(settled[order])
    if len(known):
        root[known] = known[0]
    before = root.copy()
    own = np.zeros(int(flat.max()) + 1, np.uint8)
    for i in range(len(sets)):
        others = i + 1 + np.flatnonzero(root[i + 1 : reach[i]] != root[i])
        if not len(others):
            continue
        mine = flat[start[i] : start[i + 1]]
        own[mine] = 1
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            firsts = np.r_[0, np.cumsum(size[some])]
            place = np.repeat(start[some] - firsts[:-1], size[some]) + np.arange(firsts[-1])
            shared = np.add.reduceat(own[flat[place]], firsts[:-1], dtype=np.int64)
            for j in some[9 * shared >= 4 * (size[i] + size[some])].tolist():  # as in similar
                if root[j] != root[i]:
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
        own[mine] = 0
    joined = np.flatnonzero(root != before)  # the links among settled ones are known
    return order[joined], order[root[joined]]


def star_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """g, node, rep, near: every member of a group (g, node) beside the group's representative, its smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [a == b or similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for a, b, x, y in zip(*[batch[c].to_pylist() for c in ("node", "rep", "hashes", "rep_hashes")], strict=True)]
            yield pa.record_batch([batch["g"], batch["node"], batch["rep"], pa.array(near, pa.bool_())], names=["g", "node", "rep", "near"])

    reps = groups.groupBy("g").agg(F.min("node").alias("rep"))
    reps = written(reps.join(sets.select(F.col("node").alias("rep"), F.col("hashes").alias("rep_hashes")), "rep"), scratch(groups.sparkSession, "representatives"))
    if (reps.agg(F.sum(F.octet_length("rep_hashes") + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        reps = F.broadcast(reps)
    return groups.join(sets, "node").join(reps, "g").select("g", "node", "rep", "hashes", "rep_hashes").mapInArrow(lean(run), "g long, node long, rep long, near boolean")


def links(groups: DataFrame, sets: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """a, b: links between nodes of a group (g, node), at least a spanning forest of those with a Jaccard similarity of 0.8 or more.

    sets: a table. A group with more than ``most`` members is first compared with
    its representative, which costs one comparison a member. Those that are
    similar to it are joined; what is left, and only that, is cut into blocks, and
    every block meets every block of the group's members. A family of copies is
    joined by the first step alone.
    """
    spark = groups.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, hashes, settled = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                a, b = _linked([np.frombuffer(h, np.uint64) for h in hashes], np.array(settled, bool))
                if len(a):
                    found = np.array(nodes, np.int64)
                    yield pa.record_batch([pa.array(found[a]), pa.array(found[b])], names=["a", "b"])

        for batch in batches:
            for g, node, packed, known in zip(*[batch[c].to_pylist() for c in ("shard", "node", "hashes", "settled")], strict=True):
                if g != at:
                    yield from flush()
                    at, nodes, hashes, settled = g, [], [], []
                nodes.append(node)
                hashes.append(packed)
                settled.append(known)
        yield from flush()

    size = written(groups.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("g", F.ceil(F.col("n") / most).cast("int").alias("blocks")), scratch(spark, "large"))
    n_large = size.count()
    met = groups.select(F.col("g").alias("shard"), "node", F.lit(False).alias("settled"))
    star = None
    if n_large:
        size = F.broadcast(size) if n_large <= BROADCAST_SHARDS else size
        met = groups.join(size, "g", "left_anti").select(F.col("g").alias("shard"), "node", F.lit(False).alias("settled"))
        star = written(star_links(groups.join(size, "g", "left_semi"), sets), scratch(spark, "stars"))
        open_blocks = star.where("NOT near").groupBy("g").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("open"))
        shape = written(open_blocks.join(size, "g"), scratch(spark, "shapes"))  # the large groups with members that aren't joined
        if not shape.isEmpty():
            shape = F.broadcast(shape) if n_large <= BROADCAST_SHARDS else shape
            rows = star.join(shape, "g").withColumn("of", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))).withColumn("as_open", F.pmod(F.xxhash64("node", F.lit(11)), F.col("open")))
            # a member is in its block's row; one that is open is in its open block's column too
            across = F.transform(F.sequence(F.lit(0), F.col("open") - 1), lambda j: F.xxhash64("g", "of", j))
            down = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.xxhash64("g", i.cast("long"), F.col("as_open").cast("int")))
            places = F.when(F.col("near"), across).otherwise(F.array_union(across, down))
            met = met.unionByName(rows.select(F.explode(places).alias("shard"), "node", F.col("near").alias("settled")))
    compared = met.join(sets, "node").select("shard", "node", "hashes", "settled").repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(run), "a long, b long")
    return compared if star is None else compared.unionByName(star.where("near AND node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")))


def row_key(doc_id: Column) -> Column:
    """The id, or a number above all ids."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def text_node(text: Column) -> Column:
    return F.xxhash64(text, text.isNull())


def own_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, key and text of every row."""
    own = pick(docs, key=id_col, text=text_col)
    return own.select(text_node(F.col("text")).alias("node"), row_key(F.col("key")).alias("key"), "text")


def near_copies(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """node, key and root: every distinct text with its smallest id and the smallest node of its group."""
    spark = docs.sparkSession
    own = own_texts(docs, id_col, text_col)
    sketched = scratch(spark, "sketches")
    prints = written(sketches(own, words), sketched)
    same = F.min(F.struct("key", "shards", "s1", "s2")).alias("m")
    nodes = written(prints.groupBy("node").agg(same).select("node", "m.*"), scratch(spark, "nodes"))
    remove(spark, sketched)
    with recorded() as made:
        joined = components(_compared(own, nodes, words, shard_rows, group_rows))
    for path in made[:-1]:  # the last holds the components
        remove(spark, path)
    return nodes.join(joined, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))


def _compared(own: DataFrame, nodes: DataFrame, words: int, shard_rows: int, group_rows: int) -> DataFrame:
    """a, b: links between the nodes (node, key, shards, s1, s2), whose texts are in own (node, key, text)."""
    spark = own.sparkSession
    groups = written(candidates(nodes, shard_rows=shard_rows), scratch(spark, "candidates"))
    wanted = groups.select("node").distinct().join(nodes.select("node", "key"), "node")
    sets = shingle_sets(own.join(wanted, ["node", "key"], "left_semi"), words).groupBy("node").agg(F.first("hashes").alias("hashes"))
    return links(groups, written(sets, scratch(spark, "shingles")), group_rows)


def first_copies(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key and node of the row that stays for each group: the smallest id, then the smallest node."""
    found = near_copies(docs, words, id_col, text_col)
    return found.groupBy("root").agg(F.min(F.struct("key", "node")).alias("m")).select("m.*")
