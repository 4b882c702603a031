"""Token counts of whole documents by overlap resynchronisation.

A document longer than ``chunk_chars`` is encoded by the library as overlapping
chunks, each with the character offsets at which its tokens begin. Neighbouring
chunks are spliced at an offset where both have a token begin and which is proven
stable: a stable cut (see pretokens), where a token of the whole text begins
whatever stands around it. If the overlap holds no such offset it is widened, and
the left chunk with it, at last to the whole text, so the sum is always the
library's own count. Shorter documents are looked up piece by piece between
stable cuts.

Null text counts as empty. Empty text has no tokens. Texts in which the string
of an added token occurs, and tokenizers without the byte-level pattern, are
given to the library whole. Repeated rows each have their own result.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import lean, pick, worker_state
from lodestar.llm.pretokens import BYTE_LEVEL, PieceCache

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
_CUT = re.compile(r" (?=\S)")


def packed(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Library:
    """A tokenizer file and, where its texts may be cut, the encoded pieces seen so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.added: list[str] = []
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: model.encode(text, num_threads=1)
            return
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        split = self.tokenizer.pre_tokenizer
        self.cuts = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and self.tokenizer.normalizer is None
        self.fast = self._merged(path) if self.cuts else None
        self.cache = PieceCache(self._encode)

    def _merged(self, path: str):
        """The vocabulary's own merges in a faster engine; None unless its ids are in the order of its merges."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, letter = model["vocab"], _byte_letters()
        if model.get("ignore_merges") or model.get("dropout") or set(vocab) < set(letter):
            return None
        ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if ids != sorted(ids):
            return None
        ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)
        return tiktoken.Encoding("pieces", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, found: list[str]) -> list[bytes]:
        """The packed ids of each piece.

        Pieces of letters that all Unicode versions agree on go through the fast
        engine, in one text: stable cuts keep them apart. All others, by the library.
        """
        out: list[bytes] = [b""] * len(found)
        plain = [i for i, p in enumerate(found) if p[:1] == " " and not p[1:2].isspace() and (p.isascii() or max(p) < "\u0250")] if self.fast else []
        if plain:
            text = "".join([found[i] for i in plain])
            ids = np.array(self.fast(text), "<u4")
            ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(found[i].encode()) for i in plain]), side="right")
            raw, start = ids.tobytes(), 0
            for i, end in zip(plain, ends.tolist(), strict=True):
                out[i] = raw[4 * start : 4 * end]
                start = end
        rest = sorted(set(range(len(found))).difference(plain))
        for i, e in zip(rest, self.tokenizer.encode_batch([found[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = packed(e.ids)
        return out

    def may_cut(self, text: str) -> bool:
        return self.cuts and not any(a in text for a in self.added)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        if not self.cuts:
            return [packed(self.whole(t)) for t in texts]
        cut = [self.may_cut(t) for t in texts]
        found = iter(self.cache.texts([t for t, c in zip(texts, cut, strict=True) if c]))
        return [next(found) if c else packed(self.whole(t)) for t, c in zip(texts, cut, strict=True)]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def library(path: str) -> Library:
    """One per Python worker, kept from task to task."""
    return worker_state(__name__, path, lambda: Library(path))


class Chunk:
    """A chunk as the library encodes it: where its tokens begin (offsets in the document, ascending)."""

    def __init__(self, lib: Library, text: str, start: int, end: int):
        self.start, self.end = start, end
        self.starts = [start + a for a, _ in lib.tokenizer.encode(text[start:end], add_special_tokens=False).offsets]

    def before(self, at: int) -> int:
        """Tokens that begin before an offset of the document."""
        return bisect_left(self.starts, at)

    def begins(self, at: int) -> bool:
        """Whether a token begins at a stable cut. Its offset may leave out the leading space."""
        i = self.before(at)
        return i < len(self.starts) and self.starts[i] <= at + 1


def stable_cuts(text: str, start: int, end: int) -> list[int]:
    """Offsets of the stable cuts in text[start:end]: spaces that a non-space follows."""
    return [start + m.start() for m in _CUT.finditer(text[start : end + 1])]


def spliced(left: Chunk, right: Chunk, cuts: list[int]) -> int | None:
    """The middle one of the cuts at which both chunks have a token begin; None if they agree at none."""
    common = [c for c in cuts if left.begins(c) and right.begins(c)]
    return common[len(common) // 2] if common else None


def count_tokens(lib: Library, text: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int]:
    """Tokens of the whole text, and the chunks that were encoded for it."""
    if not text:
        return 0, 1
    if not lib.may_cut(text):
        return len(lib.whole(text)), 1
    if len(text) <= chunk_chars:
        return len(lib.ids([text])[0]) // 4, 1
    size, total, encoded = len(text), 0, 1
    left, origin = Chunk(lib, text, 0, min(size, chunk_chars + overlap)), 0
    while left.end < size:
        width = overlap
        while True:
            start = max(origin, left.end - width)
            right = Chunk(lib, text, start, min(size, left.end + chunk_chars))
            encoded += 1
            at = spliced(left, right, stable_cuts(text, start + 1, left.end - 1))
            if at is not None:
                break
            # no proven boundary in the overlap: a wider one, and once it is all of the left chunk, that chunk goes on
            width *= 2
            if start == origin:
                left = Chunk(lib, text, origin, min(size, left.end + width))
                encoded += 1
                if left.end == size:
                    return total + len(left.starts), encoded
        total += left.before(at) - left.before(origin)
        left, origin = right, at
    return total + len(left.starts) - left.before(origin), encoded


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_chunks for every row.

    Runs where the scan puts the rows: no shuffle, no state but a bounded cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            counts, chunks = [0] * len(texts), [1] * len(texts)
            for at in range(0, len(texts), 1000):
                short = [i for i in range(at, min(at + 1000, len(texts))) if len(texts[i]) <= chunk_chars]
                for i, ids in zip(short, lib.ids([texts[i] for i in short]), strict=True):
                    counts[i] = len(ids) // 4
            for i, text in enumerate(texts):
                if len(text) > chunk_chars:
                    counts[i], chunks[i] = count_tokens(lib, text, chunk_chars, overlap)
            sizes = [len(t.encode()) for t in texts]
            yield pa.record_batch([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_()), pa.array(chunks, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    own = pick(docs, doc_id=id_col, text=text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")


def over_limit_share(counts: DataFrame) -> DataFrame:
    """One row: documents, tokens, documents over the limit and their share."""
    return counts.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.count_if("over_limit").alias("n_over"), F.avg(F.col("over_limit").cast("int")).alias("share_over"))
