"""Scores of pairs of texts by a model that each worker loads once.

A model's cost goes by the longest pair of the batch it is given, so the pairs of an Arrow batch are put in order
of length and scored in micro-batches of bounded size, and the scores put back in the order of the rows. Where no
model is at hand the scorer is lexical: how much of the query's pairs of neighbouring characters the text holds.

Defined results: null texts count as empty; a pair with an empty text scores 0 with the lexical scorer; an empty
table gives an empty result; further columns are carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]

#: Pairs of a micro-batch, and characters of it when padded to its longest pair.
BATCH_PAIRS, BATCH_CHARS = 64, 1 << 16


def _pairs_of(text: str) -> set[str]:
    bare = "".join(text.split())
    return {bare[i : i + 2] for i in range(len(bare) - 1)} or set(bare)


def lexical_scorer() -> Scorer:
    """The default model: of the smaller set of character pairs, the part that the other holds."""

    def score(queries: Sequence[str], texts: Sequence[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts, strict=True):
            a, b = _pairs_of(q), _pairs_of(t)
            out.append(len(a & b) / min(len(a), len(b)) if a and b else 0.0)
        return out

    return score


def micro_batches(lengths: np.ndarray, pairs: int = BATCH_PAIRS, chars: int = BATCH_CHARS) -> Iterator[np.ndarray]:
    """Positions of pairs of about one length, at most ``pairs`` and, padded, ``chars`` at a time; a longer pair is alone."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and end - start < pairs and (end - start + 1) * int(lengths[order[end]]) <= chars:
            end += 1
        yield order[start:end]
        start = end


def score_pairs(df: DataFrame, query: str, text: str, into: str, load: Callable[[], Scorer] = lexical_scorer) -> DataFrame:
    """``df`` with the score of each pair of two columns; ``load`` makes the model, once a task."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in parts:
            q, t = queries.fillna("").to_numpy(), texts.fillna("").to_numpy()
            lengths = np.fromiter((len(a) + len(b) for a, b in zip(q, t, strict=True)), dtype=np.int64, count=len(q))
            scores = np.zeros(len(q))
            for at in micro_batches(lengths):
                scores[at] = model(q[at].tolist(), t[at].tolist())
            yield pd.Series(scores)

    return df.withColumn(into, run(F.col(query), F.col(text)))


def rerank_texts(hits: DataFrame, n: int, query: str = "query", text: str = "text", load: Callable[[], Scorer] = lexical_scorer) -> DataFrame:
    """The best ``n`` hits (query_id, rank, ...) of each query by the score of its text, earlier rank first among equals."""
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    scored = score_pairs(hits, query, text, "rerank_score", load)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
