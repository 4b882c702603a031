"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms of a text: the shapes of its words (letter case, digits, symbols, runs
shortened), hashed lower-cased words, shapes of lines, lines that came before,
word counts by size. Term counts are damped, weighed by their rarity among the
sample, brought to unit length and projected on the leading singular vectors of
the labelled sample: the latent-semantic vectors.

The labelled vectors are broadcast: at most ``sample`` labelled documents (those
with the smallest hashes of their ids) of ``rank`` numbers each, a fixed bound.
Every document's cosines with all of them are exact, one matrix product for a
block of documents. The ``neighbours`` most similar labels vote, each weighing a
power of its similarity; class sizes in the sample are evened out.

Defined results: null text counts as empty; an empty text has its own term and
gets a score like any other; without labelled rows, or with one class only, the
score is 0.5 or that class; similarities are compared to six decimals and ties
between neighbours go by their place in the sample (ids in order, as strings); a
document with several labels has the highest, one with several texts that of the
smallest hash; rows are never dropped and repeated rows each have their own
result.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import crc_fold, lean, pick, worker_state

SAMPLE = 4096
WIDTH = 4096
RANK = 48
NEIGHBOURS = 25
POWER = 8.0
CACHE_WORDS = 300_000
_UPPER, _LOWER, _DIGIT = regex.compile(r"\p{Lu}+"), regex.compile(r"[\p{L}\p{M}--\p{Lu}]+", regex.V1), regex.compile(r"\p{N}+")
_REPEAT = regex.compile(r"(.)\1+", regex.DOTALL)


def _cell(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % WIDTH


def shape(word: str) -> str:
    """Cab!! -> Aa!, 12% -> 0%, word -> a; at most 12 characters."""
    return _REPEAT.sub(r"\1", _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word))))[:12]


class Terms:
    """Texts as sparse term counts, with a bounded cache of words seen in this worker."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def cells(self, word: str) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            found = _cell("s " + shape(word)), _cell("w " + word.lower())
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = found
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.array([_cell("empty")]), np.ones(1)
        pairs = [*map(self.cells, words)]
        cells = np.array(pairs, np.int64)
        seen, again = set(), 0
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        for line in lines:
            again += line in seen
            seen.add(line)
        n = len(words)
        at, count = np.unique(cells[:, 1], return_counts=True)
        at2, count2 = np.unique(cells[:, 0], return_counts=True)
        # shapes carry how a text is written: they weigh by their share of the words
        value = np.concatenate([np.log1p(count) / np.sqrt(n), 4.0 * np.sqrt(count2 / n)])
        extra = [("size %d" % min(12, n.bit_length()), 0.5), ("again %d" % (10 * again // max(1, len(lines))), 1.5 if again else 0.25)]
        return np.concatenate([at, at2, [_cell(t) for t, _ in extra]]), np.concatenate([value, [v for _, v in extra]])


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), WIDTH), np.float32)
    for i, (at, value) in enumerate(rows):
        np.add.at(out[i], at, value)
    out *= weight
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Voters:
    """The labelled latent-semantic vectors and how to make more."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int, neighbours: int, power: float):
        self.labels, self.neighbours, self.power = labels.astype(np.float32), neighbours, power
        present = np.zeros(WIDTH)
        for at, _ in rows:
            present[np.unique(at)] += 1
        self.weight = np.log((1 + len(rows)) / (1 + present)).astype(np.float32) + 1
        self.axes = np.zeros((WIDTH, 0), np.float32)
        self.vectors = np.zeros((len(rows), 0), np.float32)
        if rows:
            matrix = _dense(rows, self.weight)
            self.axes = _leading(matrix, min(rank, *matrix.shape))
            self.vectors = self._unit(matrix @ self.axes)
        # each class votes with the same total weight over the sample
        share = np.array([max(1, int((labels == k).sum())) for k in (0, 1)], np.float32)
        self.vote = (len(labels) / (2 * share[labels.astype(int)])).astype(np.float32) if len(labels) else np.zeros(0, np.float32)
        self.vote = np.sqrt(self.vote)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(rows), 0.5)
        cosine = self._unit(_dense(rows, self.weight) @ self.axes) @ self.vectors.T
        near = self._nearest(np.round(cosine, 6), min(self.neighbours, cosine.shape[1]))
        similar = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3) ** self.power * self.vote[near]
        return (similar * self.labels[near]).sum(axis=1) / similar.sum(axis=1)

    @staticmethod
    def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
        """The k most similar of each row, in the order of their places; among equals at the edge the first places."""
        edge = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k, None]
        near = cosine >= edge
        for i in np.flatnonzero(near.sum(axis=1) > k):  # rows with a tie at the edge
            equal = np.flatnonzero(cosine[i] == edge[i])
            near[i, equal[k - np.count_nonzero(cosine[i] > edge[i]) :]] = False
        return np.nonzero(near)[1].reshape(-1, k)


def _leading(matrix: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    rng = np.random.Generator(np.random.PCG64(3))
    q = rng.standard_normal((matrix.shape[1], min(rank + 16, *matrix.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(matrix.T @ (matrix @ q))
    small = matrix @ q
    _, _, v = np.linalg.svd(small, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS, power: float = POWER, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Voters:
    """The voters: at most ``sample`` labelled documents, those with the smallest hashes of their ids."""
    marked = pick(labels, label_id=id_col, label=label_col).where("label_id IS NOT NULL AND label IN (0, 1)")
    chosen = marked.groupBy("label_id").agg(F.max(F.col("label").cast("int")).alias("label")).orderBy(F.xxhash64(F.lit(11), "label_id"), "label_id").limit(sample)
    own = pick(docs, doc_id=id_col, text=text_col)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Terms()
        for batch in batches:
            rows = [made.of(t or "") for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"].cast(pa.string()), batch["label"], pa.array([r[0].astype("<i8").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f8").tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "cells", "counts"])

    texts = own.join(F.broadcast(chosen), own["doc_id"] == chosen["label_id"]).select("doc_id", "text", "label")  # at most `sample` ids
    one = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # so at most `sample` rows, whatever repeats
    found = sorted(one.select("doc_id", "text", "label").mapInArrow(lean(terms), "doc_id string, label int, cells binary, counts binary").collect(), key=lambda r: r["doc_id"])
    rows = [(np.frombuffer(r["cells"], "<i8"), np.frombuffer(r["counts"], "<f8")) for r in found]
    return Voters(rows, np.array([r["label"] for r in found], int), rank, neighbours, power)


def score(docs: DataFrame, voters: Voters, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(voters))  # its size is fixed by SAMPLE, WIDTH and RANK
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, terms = worker_state(__name__, key, lambda: (pickle.loads(shared.value), Terms()))
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                found = voters.scores([terms.of(t or "") for t in part["text"].to_pylist()])
                yield pa.record_batch([part["doc_id"], pa.array(found.astype(float), pa.float64())], names=["doc_id", "score"])

    own = pick(docs, doc_id=id_col, text=text_col)
    return own.mapInArrow(lean(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")


def score_with_folds(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out (id's fold is ``out``), score, predicted: learned from the labels of the other folds."""
    voters = fit(docs, labels.where(crc_fold(F.col("doc_id"), folds) != out))
    found = score(docs, voters)
    return found.select("doc_id", (crc_fold(F.col("doc_id"), folds) == out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
