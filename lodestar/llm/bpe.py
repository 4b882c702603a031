"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of tokens. Every pair that can merge waits in the
bucket of its rank. A bitmap of three levels over the ranks says which buckets
hold anything, so the next rank is found by three find-first-set steps. An entry
whose pair has changed meanwhile is stale and skipped. The work is linear in the
pre-token's length but for the sorting of buckets, which suits very long
pre-tokens; there is no limit on their length. New pre-tokens of many documents
share one queue, so its levels are walked once for all of them.

Null text counts as empty; empty text has no ids and decodes to nothing.
Repeated rows each have their own result. Columns besides id and text are left
out, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import lean, pick, worker_state
from lodestar.llm.pretokens import BYTE_LEVEL, PieceCache

#: Pre-tokens kept encoded per Python worker.
CACHE_PRETOKENS = 400_000


class RankQueue:
    """Positions waiting by merge rank. Three bitmap levels of 64-bit words find the lowest rank."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, bucket: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = bucket
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank and its bucket, which is closed."""
        t = (self.top & -self.top).bit_length() - 1
        m = t << 6 | (self.mid[t] & -self.mid[t]).bit_length() - 1
        rank = m << 6 | (self.low[m] & -self.low[m]).bit_length() - 1
        self.low[m] &= self.low[m] - 1
        if not self.low[m]:
            self.mid[t] &= self.mid[t] - 1
            if not self.mid[t]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class RankVocabulary:
    """A rank file and the encoder over it."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.cuts = pattern == BYTE_LEVEL  # else no place is proven stable, and texts are encoded whole
        rule = regex.compile(pattern)
        self.find = rule.findall if self.cuts else lambda text: [m.group() for m in rule.finditer(text)]
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.byte_pairs = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        # which two tokens merge into one, for every way to cut a token in two
        self.merged: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.merged[a * self.size + b] = rank
        self.queue = RankQueue(self.size)
        self.known: dict[str, bytes] = {}
        self.cache = PieceCache(self._encode)

    def merge(self, raws: list[bytes]) -> list[bytes]:
        """The packed ids of pre-tokens, which go through one queue together.

        Pre-tokens share no pair, so the lowest rank of all is also the lowest of
        the one it is in, and each is merged in its own right order.
        """
        whole = [self.ranks.get(raw) for raw in raws]
        rest = [i for i, x in enumerate(whole) if x is None and raws[i]]
        out = [b"" if x is None else x.to_bytes(4, "little") for x in whole]
        if not rest:
            return out
        data = np.frombuffer(b"".join([raws[i] for i in rest]), np.uint8)
        ends = np.cumsum([len(raws[i]) for i in rest])
        ids_array = self.single[data]
        if ids_array.min() < 0:
            raise ValueError("the vocabulary lacks a byte")
        n = len(data)
        pairs = self.byte_pairs[data[:-1].astype(np.int32) * 256 + data[1:]]
        pairs[ends[:-1] - 1] = -1  # no pair over two pre-tokens
        at = np.flatnonzero(pairs >= 0)
        order = at[np.argsort(pairs[at], kind="stable")]
        found, starts = np.unique(pairs[order], return_index=True)
        queue, size, merged = self.queue, self.size, self.merged.get
        places = order.tolist()
        stops = [*starts.tolist()[1:], len(places)]
        for rank, a, b in zip(found.tolist(), starts.tolist(), stops, strict=False):
            queue.open(rank, places[a:b])
        ids = ids_array.tolist()
        after = np.arange(1, n + 1)
        after[ends - 1] = n
        before = np.arange(-1, n - 1)
        before[ends[:-1]] = -1
        after, before, buckets = after.tolist(), before.tolist(), queue.buckets
        while queue.top:
            rank, bucket = queue.take()
            if len(bucket) > 1:
                bucket.sort()
            lower = False
            for k, i in enumerate(bucket):
                if ids[i] < 0 or (j := after[i]) >= n or merged(ids[i] * size + ids[j]) != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                right = after[i] = after[j]
                if right < n:
                    before[right] = i
                    r = merged(rank * size + ids[right])
                    if r is not None:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            queue.open(r, [i])
                        lower |= r < rank
                left = before[i]
                if left >= 0:
                    r = merged(ids[left] * size + rank)
                    if r is not None:
                        if r in buckets:
                            buckets[r].append(left)
                        else:
                            queue.open(r, [left])
                        lower |= r < rank
                if lower and k + 1 < len(bucket):  # a lower rank has come up: it goes first
                    queue.open(rank, bucket[k + 1 :])
                    break
        kept = np.array(ids, np.int64)
        alive = kept >= 0
        count = np.cumsum(alive)[ends - 1]
        raw, start = kept[alive].astype("<u4").tobytes(), 0
        for i, end in zip(rest, count.tolist(), strict=True):
            out[i] = raw[4 * start : 4 * end]
            start = end
        return out

    def _encode(self, found: list[str]) -> list[bytes]:
        """The packed ids of pieces. Their new pre-tokens are merged together."""
        known, find = self.known, self.find
        split = [find(p) for p in found]
        new = list({t for tokens in split for t in tokens if t not in known})
        ids = dict(zip(new, self.merge([t.encode() for t in new]), strict=True))
        room = CACHE_PRETOKENS - len(known)
        if room > 0:
            known.update([(t, v) for t, v in islice(ids.items(), room) if len(t) <= 48])
        return [b"".join([ids[t] if t in ids else known[t] for t in tokens]) for tokens in split]

    def texts(self, texts: list[str]) -> list[bytes]:
        return self.cache.texts(texts) if self.cuts else self._encode(texts)

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        return self.texts([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary(path: str, pattern: str) -> RankVocabulary:
    """One per Python worker, kept from task to task."""
    return worker_state(__name__, (path, pattern), lambda: RankVocabulary(path, pattern))


def encode_decode(docs: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), decoded (binary, from the ids) of every row.

    The pieces between stable cuts of the byte-level pattern are looked up (see
    pretokens); with another pattern the pre-tokens of each text are. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(vocab, pattern)
        for batch in batches:
            for part in _slices(batch, 5000):
                ids = words.texts([t or "" for t in part["text"].to_pylist()])
                for at in range(0, max(1, len(ids)), 500):
                    some = ids[at : at + 500]
                    back = [words.decode(i) if decode else None for i in some]
                    yield pa.record_batch([part["doc_id"].slice(at, 500), pa.array(some, pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "ids", "decoded"])

    own = pick(docs, doc_id=id_col, text=text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lean(run), f"doc_id {kind}, ids binary, decoded binary")


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few documents stand in memory at once."""
    for i in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(i, rows)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
