"""Text embeddings. A model is loaded once per Python worker; the default needs none."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(width: int = 64) -> Encoder:
    """Signed hashed words, unit length: deterministic and without a model."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % width] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def embedded(text: Column, load: Callable[[], Encoder] = hashing_encoder, batch: int = 32, prefix: str = "") -> Column:
    """array<float> of a text column. ``load`` runs once per worker task, not per row."""

    @F.pandas_udf("array<float>")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in series:
            values = [prefix + (t or "") for t in texts]
            parts = [encoder(values[i : i + batch]) for i in range(0, len(values), batch)]
            yield pd.Series([row for part in parts for row in part])

    return encode(text)
