"""Language identification of words and spans: scripts, then Viterbi with a switching penalty.

Model. Per language the frequencies of letter n-grams (1 to 4, word ends marked),
hashed into a table of fixed size and smoothed, and the share of its letters in
each script. It is learned from at most ``sample`` labelled documents of each
language, those with the smallest hashes of id and text: whole texts, and a model
whose size doesn't depend on the corpus. Rows of equal id and text count once in it.

Prediction. A text is split at white space; a word counts if it has letters. The
scripts of its letters narrow the candidate languages to those that use them.
Each candidate scores the mean log frequency of the word's n-grams times the
root of its length; then Viterbi over the words of the document, with a penalty
for changing language, labels every word. Spans are the maximal runs of one
label. A document's language is the one with the most letters; its score is the
share of letters in that language's spans, times how surely the scores prefer
it to the second one.

Words are scored once per worker and looked up after that (a bounded cache), and
Viterbi runs over many documents at a time. No shuffle but that of the sample.

Defined results: null texts and texts without letters are `und` with score 0;
ties go to the first language in alphabetical order; without any training
document all are `und`; repeated rows each have their own result.
"""

from __future__ import annotations

import bisect
import itertools
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import crc_fold, lean, pick, scratch, worker_state, written

SAMPLE = 600
TABLE = 1 << 16
ORDERS = (1, 2, 3, 4)
PENALTY = 4.0
CACHE_WORDS = 300_000
#: Up to so many languages their figures are broadcast.
BROADCAST_LANGS = 10_000
#: First code points of ranges of letters and the script that begins there.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
]
_STARTS = [s for s, _ in SCRIPTS]
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(piece: str) -> str:
    """What of a piece are letters, lower-cased; '' if none."""
    found = _NOT_LETTERS.sub("", piece).lower()
    return found if _LETTER.search(found) else ""


def script_of(letter: str) -> str:
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(letter)) - 1][1]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, the word of each, and each letter's script (-1 for word ends), one array each."""
    joined = " " + " ".join(words) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = codes == 32
    word = np.cumsum(space) - 1  # a word's closing space belongs to the next one, so n-grams are kept by their start
    hashes, owner = [], []
    h = np.zeros(len(codes), np.uint64)
    inner = np.zeros(len(codes), np.int64)
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)
        inner = inner[:m] + space[n - 1 :]
        start, end = space[:m], space[n - 1 :]
        ok = (inner - start - (end if n > 1 else 0) <= 0) & ~(start & end) if n > 1 else ~space[:m]
        ok &= word[:m] < len(words)
        mixed = (h[ok] ^ (h[ok] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F + 2 * n)
        hashes.append((mixed >> np.uint64(48)).astype(np.int64))
        owner.append(word[:m][ok])
    scripts = np.where(space, -1, _SCRIPT_OF[np.searchsorted(_STARTS, codes.astype(np.int64), side="right") - 1])
    return np.concatenate(hashes), np.concatenate(owner), np.stack([scripts, word])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: TABLE x languages; scripts: scripts x languages, in letters."""
        self.langs = langs
        total = counts.sum(axis=0)
        self.log = np.log((counts + 0.5) / (total + 0.5 * TABLE)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.uses = share >= 0.005

    def score(self, words: list[str]) -> np.ndarray:
        """words x languages."""
        size = len(self.langs)
        if not words:
            return np.zeros((0, size), np.float32)
        grams, owner, (script, word) = _grams(words)
        many = np.bincount(owner, minlength=len(words))
        out = np.stack([np.bincount(owner, self.log[grams, k], len(words)) for k in range(size)], axis=1)
        out /= np.maximum(many, 1)[:, None]
        out *= np.sqrt(np.fromiter(map(len, words), float, len(words)))[:, None]
        # candidates: languages that use every script of the word, or any script of it, or else all
        there = np.zeros((len(words), len(SCRIPT_NAMES)), bool)
        keep = (script >= 0) & (word < len(words))
        there[word[keep], script[keep]] = True
        usable = there.astype(np.int32) @ self.uses.astype(np.int32)
        best = usable.max(axis=1, keepdims=True)
        out[(usable < best)] -= 30.0
        return (out - out.max(axis=1, keepdims=True)).astype(np.float32)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best label of each row of each document's scores (words x languages); documents go together, step by step."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
    if not len(sizes) or not sizes[0]:
        return out
    starts = np.r_[0, np.cumsum(sizes)]
    rows = np.concatenate([scores[i] for i in order])
    back = np.zeros(rows.shape, np.int8)
    active = len(order) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    value = rows[starts[:-1][: active[0]]].copy()
    for t in range(1, int(sizes[0])):
        n = active[t]
        at = starts[:n] + t
        v = value[:n]
        best = v.argmax(axis=1)
        top = v[np.arange(n), best] - penalty
        stay = v >= top[:, None]
        back[at] = np.where(stay, np.arange(v.shape[1]), best[:, None])
        value[:n] = np.where(stay, v, top[:, None]) + rows[at]
    label = value.argmax(axis=1)
    found = np.zeros(len(rows), np.int8)
    state = np.zeros(len(order), np.int64)
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = active[t]
        last = sizes[:n] == t + 1
        state[:n][last] = label[:n][last]
        at = starts[:n] + t
        found[at] = state[:n]
        state[:n] = back[at, state[:n]]
    for k, i in enumerate(order):
        out[i] = found[starts[k] : starts[k + 1]]
    return out


class Labeller:
    """A model with its cached words, in one Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}  # piece -> row of the scores, -1 without letters
        self.rows = np.zeros((0, len(model.langs)), np.float32)
        self.lengths = np.zeros(0, np.int32)

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.place]
        if not new:
            return
        if len(self.place) + len(new) > CACHE_WORDS:
            self.place.clear()
            self.rows, self.lengths = self.rows[:0], self.lengths[:0]
            new = list(pieces)
        found = [letters(p) for p in new]
        words = [w for w in found if w]
        at = len(self.rows)
        self.rows = np.concatenate([self.rows, self.model.score(words)])
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, words), np.int32, len(words))])
        for p, w in zip(new, found, strict=True):
            self.place[p] = at if w else -1
            at += bool(w)

    def label(self, texts: list[str], penalty: float) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans (first word, word after the last, language) of each text."""
        split = [t.split() for t in texts]
        if len(self.model.langs) == 0:
            return [("und", 0.0, [])] * len(texts)
        self.learn(set(itertools.chain.from_iterable(split)))
        places = [np.fromiter(map(self.place.__getitem__, s), np.int64, len(s)) for s in split]
        words = [np.flatnonzero(p >= 0) for p in places]
        rows = [p[w] for p, w in zip(places, words, strict=True)]
        scores = [self.rows[r] for r in rows]
        out = []
        for label, w, r, s in zip(viterbi(scores, penalty), words, rows, scores, strict=True):
            if not len(label):
                out.append(("und", 0.0, []))
                continue
            amount = np.bincount(label, self.lengths[r], len(self.model.langs))
            best = int(amount.argmax())
            mean = s[label == best].mean(axis=0)
            rival = np.delete(mean, best)
            margin = float(mean[best] - rival.max()) if len(rival) else 50.0
            sure = 1 / (1 + np.exp(-min(50.0, max(-50.0, 4 * margin))))
            edge = np.flatnonzero(np.diff(label)) + 1
            first, after = np.r_[0, edge], np.r_[edge, len(label)]
            spans = [(int(w[a]), int(w[b - 1]) + 1, self.model.langs[label[a]]) for a, b in zip(first, after, strict=True)]
            out.append((self.model.langs[best], float(amount[best] / amount.sum() * sure), spans))
        return out


def train(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from labelled documents, at most ``sample`` of each language (those of the smallest hashes). Nothing is joined but by language."""
    spark = labelled.sparkSession
    own = pick(labelled, doc_id=id_col, text=text_col, lang=lang_col).where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text", F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id", "text"), 1).alias("u"))
    # a first cut by the hash leaves about three samples of each language, so no task sorts a whole language
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", (F.lit(3.0 * sample * 2**63) / F.col("n")).alias("most"))
    sizes = written(sizes, scratch(spark, "languages"))
    few_langs = sizes.count() <= BROADCAST_LANGS

    def each(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few_langs else rows  # a row for each language

    few = own.select("lang", "u").join(each(sizes), "lang").where("u <= most").select("lang", "u").distinct()
    ranked = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u")))
    cut = ranked.where(F.col("k") <= sample).groupBy("lang").agg(F.max("u").alias("cut"))
    cut = written(cut, scratch(spark, "languages"))
    # rows of equal id and text are one: a hot row is no larger a part of the sample than any other
    texts = own.join(each(cut), "lang").where("u <= cut").groupBy("lang", "u").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n-gram and script counts of the partition, a sparse row for each language."""
        made: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = [w for w in map(letters, text.split()) if w]
                if not words:
                    continue
                grams, _, (script, _) = _grams(words)
                row = made.setdefault(lang, np.zeros(TABLE + len(SCRIPT_NAMES)))
                np.add.at(row, grams, 1)
                np.add.at(row, TABLE + script[script >= 0], 1)
        for lang, row in made.items():
            at = np.flatnonzero(row)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(row[at])], names=["lang", "cell", "n"])

    cells = texts.mapInArrow(count, "lang string, cell long, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(cells["lang"].unique())
    table = np.zeros((TABLE + len(SCRIPT_NAMES), len(langs)))
    for k, lang in enumerate(langs):
        of = cells[cells["lang"] == lang]
        table[of["cell"].to_numpy(), k] = of["n"].to_numpy()
    return Model(langs, table[:TABLE], table[TABLE:])


def label_documents(docs: DataFrame, model: Model, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, spans (array of first, after, lang: word numbers) of every row.

    carry: further columns of the result, from which columns of the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # its size is fixed by TABLE and the languages
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = worker_state(__name__, key, lambda: Labeller(pickle.loads(shared.value)))
        span = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = labeller.label([t or "" for t in part["text"].to_pylist()], penalty)
                spans = pa.array([[{"first": a, "after": b, "lang": x} for a, b, x in s] for _, _, s in found], span)
                made = [part["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans]
                yield pa.record_batch([*made, *[part[c] for c in others]], names=["doc_id", "lang_pred", "score", "spans", *others])

    own = pick(docs, doc_id=id_col, text=text_col, **(carry or {}))
    others = own.columns[2:]
    shape = "lang_pred string, score double, spans array<struct<first: int, after: int, lang: string>>"
    schema = T.StructType([own.schema["doc_id"], *T.StructType.fromDDL(shape).fields, *[own.schema[c] for c in others]])
    return own.mapInArrow(lean(run), schema)


def held_out(docs: DataFrame, folds: int = 5, id_col: str = "doc_id") -> DataFrame:
    return docs.withColumn("held_out", crc_fold(F.col(id_col), folds) == 0)


def predict_with_folds(docs: DataFrame, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans: learned from the documents that aren't held out."""
    model = train(held_out(docs, folds).where("NOT held_out"), sample)
    return held_out(label_documents(docs, model), folds)
