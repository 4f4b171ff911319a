"""Embedding and reranking providers. Models are pluggable; the defaults are deterministic and lexical."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.overlap import bigrams, coverage

DIMENSIONS = 256


def hashed_bigrams(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of hashed pairs of neighbouring characters."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        bare = "".join((text or "").split()).lower()
        for i in range(max(len(bare) - 1, min(len(bare), 1))):
            h = zlib.crc32(bare[i : i + 2].encode())
            row[h % dimensions] += 1 if h & 0x80000000 else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size == 0, 1, size)


def embed_column(df: DataFrame, text: str, into: str, provider: Callable[[list[str]], np.ndarray] = hashed_bigrams) -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(list(provider(s.fillna("").tolist())))

    return df.withColumn(into, run(F.col(text)))


def lexical_score(query: Column, text: Column) -> Column:
    """The default reranker: coverage of the query's character pairs."""
    return coverage(bigrams(query), bigrams(text))
