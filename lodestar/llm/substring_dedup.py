"""Substring deduplication over a log-structured index of window fingerprints.

A window is 13 consecutive words of one document. A word is removed if a window
that covers it also starts in a document with a smaller doc_id; windows are
judged on the input.

The index holds the fingerprints of all windows of past batches as sorted
immutable runs, cut into buckets by the leading bits, each bucket one
delta-coded block. A batch of documents (ids above all past ones) goes through
four steps:

1. Fingerprint. Documents are dealt into chunks by a hash. A chunk's task hashes
   every window, sorts, and sends one block per bucket: each distinct
   fingerprint once, with the smallest doc_id in the chunk. Blocks, not rows,
   are shuffled, so a passage that a third of all documents share costs one
   entry per chunk.
2. Merge-join. A bucket's task merges the chunks' blocks with the runs' blocks
   of the bucket. Runs are partitions of a bucketed table, so they are read in
   place and not shuffled again.
3. Verify. A fingerprint is 64 bits and a match counts only if 16 further bits
   of an independent hash of the same 13 words agree too. Entries that share the
   64 bits and differ in these are told apart and kept as two.
4. Answer. The bucket's task returns one bit per entry of each block: does an
   earlier document outside the chunk hold it? The chunk hashes its documents
   again, which gives the same order of entries, and applies the bits.

What a batch adds becomes a new run; when ``fan_in`` runs of one level exist they
are compacted into one run of the next level.

Defined results: null text has no words; texts shorter than a window lose
nothing; a window repeated in one document, or in rows of equal doc_id, has no
smaller doc_id and stays; rows with a null doc_id count as later than all others
and not earlier than each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import freed_shuffles, goes_at_exit, lean, parts, pick, remove, scratch, text_bytes, worker_state, written

WINDOW = 13
#: Text bytes of a chunk, and windows of a bucket over the whole index, on average.
CHUNK_BYTES = 6 << 20
BUCKET_WINDOWS = 5 << 18
BATCHES = 5
FAN_IN = 3
#: Ranges that a chunk's entries are cut into, and units that are joined before their run is cut again.
FAN_OUT, UNITS = 256, 64
#: Buckets of the table's files.
MOST_FILES = 8192
_STATE = "_index.json"

#: Words whose digests a Python worker keeps.
CACHE_WORDS = 300_000

_LAST = np.int64(2**63 - 1)  # stands for a null doc_id
_BLOCK = 1 << 21
#: Odd multipliers; any would do.
_P, _MIX, _R1, _R2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_S = np.uint64(29)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_GAP = re.compile(rb"[\x20\x09-\x0D]")


class WordDigests:
    """128 bits of BLAKE2b for each word, as two halves that know nothing of each other.

    Words seen in this worker are looked up. The frequent ones come first; once
    the cache is full the rest is digested each time.
    """

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.halves = np.zeros((CACHE_WORDS, 2), np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        out, missing = self.halves[at], np.flatnonzero(at < 0)
        if len(missing):
            unseen = [words[i] for i in missing.tolist()]
            new = dict.fromkeys(unseen)
            made = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in new]), "<u8").reshape(-1, 2)
            new = dict(zip(new, range(len(made)), strict=True))
            out[missing] = made[np.fromiter(map(new.__getitem__, unseen), np.int64, len(unseen))]
            size = len(self.place)
            room = min(CACHE_WORDS - size, len(made))
            self.halves[size : size + room] = made[:room]
            self.place.update(zip(itertools.islice(new, room), range(size, size + room), strict=True))
        return out


def _windows(halves: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint, from the words' first halves, and check, from their second ones, of every run of width words."""
    first, second = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
    n = len(first) - width + 1
    h, c = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(width):
        h *= _R1
        h += first[j : j + n]
        c *= _R2
        c += second[j : j + n]
    h ^= h >> np.uint64(32)
    h *= _P
    h ^= h >> _S
    c ^= c >> np.uint64(33)
    c *= _MIX
    return h, (c >> np.uint64(48)).astype(np.uint16)


class Prints:
    """The windows of a chunk's documents: distinct ones in order, and each window's place among them."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, width: int, bits: int):
        hashes, checks, owner, self.counts = [], [], [], []
        pend: list[bytes] = []
        first = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) + 1 > _BLOCK:
                self._block(pend, first, width, hashes, checks, owner)
                pend, first, size = [], i, 0
            pend.append(text)
            size += len(text) + 1
        if pend:
            self._block(pend, first, width, hashes, checks, owner)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        c = np.concatenate(checks) if checks else np.zeros(0, np.uint16)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        if bits < 64:
            h &= np.uint64(((1 << bits) - 1) << (64 - bits))
        order, new = _ordered(h, c)
        self.h, self.c = h[order][new], c[order][new]
        self.place = np.empty(len(h), np.int32)
        self.place[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.window_ids = ids[self.owner]
        self.least = np.minimum.reduceat(self.window_ids[order], starts) if len(starts) else np.zeros(0, np.int64)

    def _block(self, texts: list[bytes], first: int, width: int, hashes: list, checks: list, owner: list) -> None:
        digests, found, counts = worker_state(__name__, "words", WordDigests), [], []
        for words in map(_word_lists, texts):
            counts.append(0)
            for some in words:
                counts[-1] += len(some)
                found.append(some)
        halves = np.concatenate([digests.of(some) for some in _joined(found)]) if found else np.zeros((0, 2), np.uint64)
        self.counts += counts
        if len(halves) < width:
            return
        h, c = _windows(halves, width)
        doc = np.repeat(np.arange(first, first + len(texts), dtype=np.int32), counts)
        inside = doc[: len(h)] == doc[width - 1 :]
        hashes.append(h[inside])
        checks.append(c[inside])
        owner.append(doc[: len(h)][inside])


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text of any length, in blocks that end at a space."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _BLOCK) if len(text) - at > _BLOCK else None
        end = gap.start() if gap else len(text)
        yield (text if end - at == len(text) else text[at:end]).split()
        at = end


def _joined(lists: list[list[bytes]]) -> Iterator[list[bytes]]:
    """Lists of words joined into fewer, so that short texts are looked up together."""
    held: list[bytes] = []
    for some in lists:
        held += some
        if len(held) >= 1 << 18:
            yield held
            held = []
    yield held


def _ordered(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (h, c), and where in it a new pair begins."""
    order = np.argsort(h, kind="stable")
    hs, cs = h[order], c[order]
    new = np.r_[True, hs[1:] != hs[:-1]] if len(h) else np.zeros(0, bool)
    if np.any(~new[1:] & (cs[1:] != cs[:-1])):  # equal fingerprints of different windows
        order = np.lexsort((c, h))
        hs, cs = h[order], c[order]
        new = np.r_[True, (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])]
    return order, new


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """The text less the words that are gone and the space before each of them."""
    out, end = [], 0
    for word, drop in zip(_WORD.finditer(text), gone.tolist(), strict=True):
        if not drop:
            out.append(text[end : word.end()])
        end = word.end()
    out.append(text[end:])
    return b"".join(out)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the largest needs; the first byte tells how many."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(wide.T).tobytes()


def _wide(block: bytes, n: int) -> np.ndarray:
    width = block[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(block, np.uint8, n * width, 1).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _deltas(h: np.ndarray) -> bytes:
    return _narrow(np.diff(h, prepend=np.uint64(0)))


def _from_deltas(block: bytes, n: int) -> np.ndarray:
    return np.cumsum(_wide(block, n), dtype=np.uint64)


_SENT = "bucket int, chunk int, n long, h binary, c binary, ids binary"
_ANSWER = "kind string, bucket int, chunk int, n long, h binary, c binary"
_TABLE = "chunk int, n long, h binary, c binary, bucket int, run string"
_TYPES = {"kind": pa.string(), "bucket": pa.int32(), "chunk": pa.int32(), "n": pa.int64(), "h": pa.binary(), "c": pa.binary(), "ids": pa.binary()}


def _rows(rows: list[tuple], *names: str) -> pa.Table:
    return pa.table({k: pa.array([r[i] for r in rows], _TYPES[k]) for i, k in enumerate(names)})


def _blocks(h: np.ndarray, c: np.ndarray, ids: np.ndarray, ranges: int, first: int, count: int, unit: int) -> pa.Table:
    """Sorted entries, all in the ranges from ``first`` on, as one row for each range that has any. Ranges are equal parts of the leading 32 bits."""
    edges = (np.arange(first + 1, first + count, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges)
    at = np.r_[0, np.searchsorted(h, edges << np.uint64(32)), len(h)]
    spans = [(first + i, slice(at[i], at[i + 1])) for i in range(count) if at[i] < at[i + 1]]
    return _rows([(k, unit, s.stop - s.start, _deltas(h[s]), c[s].astype("<u2").tobytes(), _narrow(ids[s])) for k, s in spans], "bucket", "chunk", "n", "h", "c", "ids")


class _Merged:
    """Blocks of several units as one sorted run: each entry once, with the smallest id of any unit."""

    def __init__(self, blocks: pa.Table):
        self.units, self.sizes = blocks["chunk"].to_pylist(), blocks["n"].to_pylist()
        h = np.concatenate([_from_deltas(x.as_py(), n) for x, n in zip(blocks["h"], self.sizes, strict=True)])
        c = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in blocks["c"]])
        self.ids = np.concatenate([_wide(x.as_py(), n) for x, n in zip(blocks["ids"], self.sizes, strict=True)])
        self.order, self.new = _ordered(h, c)
        starts = np.flatnonzero(self.new)
        self.least = np.minimum.reduceat(self.ids[self.order], starts)
        self.h, self.c = h[self.order][starts], c[self.order][starts]

    def answers(self, bucket: int, earlier: np.ndarray) -> list[tuple]:
        """A row for each unit: which of its entries an earlier document outside the unit holds, given which of the run's are held outside it."""
        group = np.cumsum(self.new) - 1
        own = np.empty(len(self.ids), bool)
        own[self.order] = earlier[group] | (self.ids[self.order] > self.least[group])
        ends = np.cumsum(self.sizes)
        return [(bucket, unit, n, np.packbits(own[end - n : end]).tobytes()) for unit, n, end in zip(self.units, self.sizes, ends.tolist(), strict=True)]


def _bits(answers: pa.Table) -> np.ndarray:
    """The answers of neighbouring ranges as one array, in the order of the ranges."""
    rows = sorted(zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["h"].to_pylist(), strict=True))
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for _, n, x in rows]).astype(bool) if rows else np.zeros(0, bool)


def _levels(buckets: int, fan_out: int, units: int) -> list[int]:
    """How many ranges the entries are cut into at each level: fan_out at first, then up to ``units`` times as many; at last ``buckets`` or a little more."""
    out = [min(buckets, fan_out)]
    while out[-1] < buckets:
        out.append(out[-1] * min(units, -(-buckets // out[-1])))
    return out


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints in a folder that all executors reach.

    All runs are partitions of one bucketed table, so that one scan reads a bucket
    of all of them in one task and nothing of the past is shuffled. The number of
    ``buckets`` is fixed for the index's life: choose it for the size the index
    will grow to. ``save`` makes the present state the one that ``open`` finds.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, width: int = WINDOW, fan_in: int = FAN_IN, bits: int = 64, fan_out: int = FAN_OUT, units: int = UNITS):
        self.spark, self.path, self.width, self.fan_in, self.bits, self.units = spark, path, width, fan_in, bits, units
        self.levels = _levels(buckets, fan_out, units)
        self.buckets = self.levels[-1]
        self.name = f"fingerprints_{uuid.uuid4().hex}"
        self.runs: list[tuple[int, str]] = []  # level, partition
        self.answer: str | None = None
        files = min(self.buckets, MOST_FILES)  # Spark bounds a table's buckets; ours are finer and share them
        spark.sql(f"CREATE TABLE {self.name} ({_TABLE}) USING parquet OPTIONS (compression 'uncompressed') PARTITIONED BY (run) CLUSTERED BY (bucket) INTO {files} BUCKETS LOCATION '{path}'")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex | None:
        """The index that was saved at path; None if there is none."""
        fs, state = _file(spark, f"{path}/{_STATE}")
        if not fs.exists(state):
            return None
        stream = fs.open(state)
        saved = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        index = cls(spark, path, saved["levels"][-1], saved["width"], saved["fan_in"], saved["bits"], units=saved["units"])
        index.levels, index.runs = saved["levels"], [tuple(r) for r in saved["runs"]]
        index._found()
        return index

    def save(self) -> None:
        fs, fresh = _file(self.spark, f"{self.path}/{_STATE}.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.writeBytes(json.dumps({"levels": self.levels, "units": self.units, "width": self.width, "fan_in": self.fan_in, "bits": self.bits, "runs": self.runs}))
        out.close()
        state = _file(self.spark, f"{self.path}/{_STATE}")[1]
        fs.delete(state, False)
        if not fs.rename(fresh, state):
            raise RuntimeError(f"the state of {self.path} could not be written")

    def close(self) -> None:
        """Forgets the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def drop(self) -> None:
        self.close()
        remove(self.spark, self.path)

    def _found(self) -> None:
        """A catalog that lists partitions is told of those in the folder."""
        try:
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        except AnalysisException:
            pass
        self.spark.catalog.refreshTable(self.name)

    def _write(self, df: DataFrame) -> None:
        """Rows with their partition in ``run``, added to the table."""
        with freed_shuffles(self.spark):
            df.select("chunk", "n", "h", "c", "bucket", "run").write.mode("append").insertInto(self.name)

    def _read(self, *runs: str) -> DataFrame:
        return self.spark.table(self.name).where(F.col("run").isin(*runs))

    def _history(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], "bucket int, n long, h binary, c binary")
        return self._read(*[r for _, r in self.runs]).select("bucket", "n", "h", "c")

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            try:  # a catalog that lists partitions has to be told
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (run='{run}')")
            except AnalysisException:
                pass
            remove(self.spark, f"{self.path}/run={run}")
        self.spark.catalog.refreshTable(self.name)

    def add(self, batch: DataFrame, chunks: int, base: int = 0, spaces: bool = False) -> DataFrame:
        """Takes a batch (doc_id, text, others) in; doc_id, n_words, n_removed, kept (binary) and the others of each row.

        base: no id of the batch is below it (ids are coded from there).
        spaces: kept has the text's own white space, and all of a text that loses nothing.
        """
        width, bits, units, levels = self.width, self.bits, self.units, self.levels

        def sort_key(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
            texts = [(t or "").encode() for t in table["text"].to_pylist()]
            ids = table["doc_id"].fill_null(int(_LAST)).to_numpy()
            order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
            return table.drop_columns(["text", "chunk"]).take(order), [texts[i] for i in order], ids[order]

        def fingerprint(table: pa.Table) -> pa.Table:
            _, texts, ids = sort_key(table)
            p = Prints(texts, ids, width, bits)
            return _blocks(p.h, p.c, (np.minimum(p.least, _LAST) - base).astype(np.uint64), levels[0], 0, levels[0], table["chunk"][0].as_py())

        def gather(ranges: int, finer: int):
            """Blocks of one range and of neighbouring units become one run, which is cut into finer ranges."""

            def one(table: pa.Table) -> pa.Table:
                run, k = _Merged(table), finer // ranges
                return _blocks(run.h, run.c, run.least, finer, k * table["bucket"][0].as_py(), k, table["unit"][0].as_py())

            return one

        def resolve(blocks: pa.Table, answers: pa.Table) -> pa.Table:
            """The way back: answers for the run of several units become answers for each of them."""
            return _rows(_Merged(blocks).answers(blocks["bucket"][0].as_py(), _bits(answers)) if blocks.num_rows else [], "bucket", "chunk", "n", "h")

        def merge(new: pa.Table, old: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if new.num_rows:
                run, bucket = _Merged(new), new["bucket"][0].as_py()
                past = np.zeros(len(run.h), bool)
                for x, k, n in zip(old["h"], old["c"], old["n"].to_pylist(), strict=True):
                    past |= _held(run.h, run.c, _from_deltas(x.as_py(), n), np.frombuffer(k.as_py(), "<u2"))
                out = [("answer", *row, b"") for row in run.answers(bucket, past)]
                fresh = ~past
                if fresh.any():
                    out.append(("run", bucket, -1, int(fresh.sum()), _deltas(run.h[fresh]), run.c[fresh].tobytes()))
            return _rows(out, "kind", "bucket", "chunk", "n", "h", "c")

        others = [f for f in batch.schema.fields if f.name not in ("doc_id", "text")]
        schema = T.StructType([batch.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType()), *others])

        def apply(docs: pa.Table, answers: pa.Table) -> pa.Table:
            rows, texts, ids = sort_key(docs)
            p = Prints(texts, ids, width, bits)
            earlier = _bits(answers)
            if len(earlier) != len(p.h):
                raise RuntimeError("the index answered for other windows than the chunk has")
            copied = earlier[p.place] | (p.window_ids > p.least[p.place])
            removed, kept, at = [], [], 0
            for text, n in zip(texts, p.counts, strict=True):
                w = max(0, n - width + 1)
                hit = copied[at : at + w]
                at += w
                if not hit.any():
                    removed.append(0)
                    kept.append(text if spaces else b" ".join(text.split()))
                    continue
                step = np.zeros(n + 1, np.int32)
                where = np.flatnonzero(hit)
                np.add.at(step, where, 1)
                np.add.at(step, where + width, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(_without(text, gone) if spaces else b" ".join([x for x, g in zip(text.split(), gone.tolist(), strict=True) if not g]))
            out = pa.table([rows["doc_id"], pa.array(p.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])
            for f in others:
                out = out.append_column(f.name, rows[f.name])
            return out

        # rows without an id may all be equal: their place in the input, the same at each reading of it, spreads them
        spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()) if base is None else F.lit(None).cast("long")
        chunked = batch.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", spread), F.lit(chunks)).cast("int"))
        base = base or 0
        sent = chunked.select("doc_id", "text", "chunk").groupBy("chunk").applyInArrow(lean(fingerprint), _SENT)
        between: list[tuple[DataFrame, int]] = []
        for ranges, finer in zip(levels, levels[1:], strict=False):
            held = written(sent.withColumn("unit", F.floor(F.col("chunk") / units).cast("int")), scratch(self.spark, "blocks"))
            between.append((held, finer // ranges))
            sent = held.groupBy("bucket", "unit").applyInArrow(lean(gather(ranges, finer)), _SENT)
        merged = sent.groupBy("bucket").cogroup(self._history().groupBy("bucket")).applyInArrow(lean(merge), _ANSWER)
        step = uuid.uuid4().hex[:12]
        self.answer, run = f"answer{step}", f"run{step}"
        self._write(merged.withColumn("run", F.when(F.col("kind") == "run", run).otherwise(self.answer)))
        answers = self._read(self.answer).select("bucket", "chunk", "n", "h")
        for held, k in reversed(between):
            up = answers.select(F.floor(F.col("bucket") / k).cast("int").alias("up"), "bucket", "chunk", "n", "h")
            answers = held.groupBy("bucket", "unit").cogroup(up.groupBy("up", "chunk")).applyInArrow(lean(resolve), "bucket int, chunk int, n long, h binary")
        out = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean(apply), schema)
        self.runs.append((0, run))
        return out

    def applied(self) -> None:
        """The last batch's result has been written: its answers go."""
        self._forget([self.answer])

    def compact(self) -> None:
        """Merges runs of one level once there are fan_in of them. Call when a batch's result is written."""
        level = 0
        while True:
            same = [r for k, r in self.runs if k == level]
            if len(same) < self.fan_in:
                if not any(k > level for k, _ in self.runs):
                    return
                level += 1
                continue
            name = f"run{uuid.uuid4().hex[:12]}"

            self._write(self._read(*same).select("bucket", "n", "h", "c").groupBy("bucket").applyInArrow(lean(_merger(name)), "bucket int, chunk int, n long, h binary, c binary, run string"))
            self._forget(same)
            self.runs = [(k, r) for k, r in self.runs if r not in same] + [(level + 1, name)]
            level += 1


def _file(spark: SparkSession, path: str):
    """The file system and the path of a file, as the JVM knows them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _merger(run: str):
    """A bucket's blocks of several runs as one block of the run."""

    def one(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        h = np.concatenate([_from_deltas(x.as_py(), n) for x, n in zip(table["h"], sizes, strict=True)])
        c = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table["c"]])
        order, _ = _ordered(h, c)  # runs have no entry in common
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "chunk": pa.array([-1], pa.int32()), "n": [len(h)], "h": pa.array([_deltas(h[order])], pa.binary()), "c": pa.array([c[order].tobytes()], pa.binary()), "run": [run]})

    return one


def _held(uh: np.ndarray, uc: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which of the entries (uh, uc) a run's sorted block (h, c) holds."""
    if not len(h):
        return np.zeros(len(uh), bool)
    at = np.searchsorted(h, uh)
    inside = np.minimum(at, len(h) - 1)
    hit = (h[inside] == uh) & (c[inside] == uc)
    # a block may hold several entries with the same 64 bits
    odd = np.flatnonzero((h[inside] == uh) & ~hit)
    for i in odd.tolist():
        j = int(at[i])
        while j < len(h) and h[j] == uh[i]:
            hit[i] |= c[j] == uc[i]
            j += 1
    return hit


def remove_copied_windows(
    docs: DataFrame, width: int = WINDOW, batches: int = BATCHES, fan_in: int = FAN_IN, chunk_bytes: int = CHUNK_BYTES, bucket_windows: int = BUCKET_WINDOWS, bits: int = 64, id_col: str = "doc_id", text_col: str = "text",
    carry: dict[str, str] | None = None, spaces: bool = False, index_path: str | None = None, index_buckets: int | None = None, fan_out: int = FAN_OUT, units: int = UNITS,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space, as UTF-8) of every row.

    The documents enter an index in ``batches`` steps by ascending doc_id.
    carry: further columns of the result, from which columns of the input.
    spaces: kept has the white space of the text instead of single spaces.
    index_path: a folder where the index stays. One that is there already is
    continued, whatever its documents' ids were: they count as earlier.
    index_buckets: buckets of a new index that will outgrow these documents.
    """
    spark = docs.sparkSession
    own = pick(docs, doc_id=id_col, text=text_col, **(carry or {})).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows, size = text_bytes(own)
    edges = sorted({int(x) for x in own.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []}) if batches > 1 and rows else []
    index = FingerprintIndex.open(spark, index_path) if index_path else None
    if index is None:
        index = FingerprintIndex(spark, index_path or scratch(spark, "fingerprints"), index_buckets or parts(size / 6, bucket_windows, 8), width, fan_in, bits, fan_out, units)
    path, schema = scratch(spark, "kept"), None
    least = own.agg(F.min("doc_id")).first()[0] if rows else None
    known, blank = own.where("doc_id IS NOT NULL"), own.where("doc_id IS NULL")
    spans = [(low, high, low + 1 if low is not None else least or 0) for low, high in zip([None, *edges], [*edges, None], strict=True)]
    without = blank.count() if rows else 0
    if without:
        spans.append((None, None, None))
    for i, (low, high, base) in enumerate(spans):
        batch = known if base is not None else blank
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        out = index.add(batch, parts(size / max(1, len(spans)), chunk_bytes), base, spaces)
        schema = out.schema
        with freed_shuffles(spark):
            out.write.mode("append").option("compression", "zstd").parquet(path)
        index.applied()
        if i + 1 < len(spans) or index_path:
            index.compact()
    goes_at_exit(spark, path)
    if index_path:
        index.save()
        index.close()
    else:
        index.drop()
    return spark.read.schema(schema).parquet(path)


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
