"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its byte pairs (hashed into ``PAIR_TERMS``), its triples of character classes, and
the share of words that repeat the word before or an earlier one. Terms are damped and weighted by
how few labelled texts have them; the leading directions of the labelled texts (truncated SVD) turn
them into latent vectors. The labelled vectors are broadcast; every text gets exact cosines with all
of them in blocks, and the nearest vote with their labels, weighted by similarity.

The labelled sample is bounded: at most ``PER_CLASS`` texts of each label, those with the least hash
of doc_id, so the broadcast holds 2 * PER_CLASS vectors of ``DIMENSIONS`` numbers whatever the input.

Defined results: a text without words (null, empty, white) scores 0; labels that are null or for a
null doc_id are ignored, several for one doc_id count as their mean; with labels of one kind only that
kind is voted; without labels every other text scores 0.5; rows are scored independently, so repeats,
ties and further columns have no effect; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.buffers import give_back, giving_back, number_words, slices, text_bytes
from lodestream.llm.text import text_or_empty
from lodestream.storage import bound_batches

PER_CLASS = 2048
DIMENSIONS = 48
NEIGHBOURS = 15
THRESHOLD = 0.7
PAIR_TERMS = 1024
BLOCK = 512
#: Texts are turned into terms in slices of about this many bytes, and rows, which bound a worker's memory.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 512
#: The number of parts doc_ids fall into by CRC-32, and the part labels are never learnt from.
PARTS, HELD_OUT = 4, 2

_PAIR = (((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(16)) % np.uint64(PAIR_TERMS)).astype(np.int32)
#: Classes: other, lower, upper, digit, blank, line break, sentence punctuation, symbol.
_CLASS = np.zeros(256, dtype=np.int32)
for _chars, _c in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:!?'\"()-", 6), (b"#*$%&|<>@^~_+=/\\[]{}`", 7)):
    _CLASS[list(_chars)] = _c
N_TERMS = PAIR_TERMS + 512 + 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % PARTS == HELD_OUT, F.lit(False))


def term_frequencies(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Damped term frequencies (float32, one row a text), and each text's number of words."""
    n = len(offsets) - 1
    begin, doc, word = number_words(buf, offsets)
    words = np.bincount(doc, minlength=n)
    out = np.zeros((n, N_TERMS), dtype=np.float32)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    if len(buf) > 1:
        same = owner[1:] == owner[:-1]
        pair = _PAIR[buf[:-1].astype(np.int32) * 256 + buf[1:]]
        out[:, :PAIR_TERMS] = np.bincount((owner[:-1] * PAIR_TERMS + pair)[same], minlength=n * PAIR_TERMS).reshape(n, -1)
    if len(buf) > 2:
        kind = _CLASS[buf]
        same = owner[2:] == owner[:-2]
        shape = kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:]
        out[:, PAIR_TERMS : PAIR_TERMS + 512] = np.bincount((owner[:-2] * 512 + shape)[same], minlength=n * 512).reshape(n, -1)
    for part in (slice(0, PAIR_TERMS), slice(PAIR_TERMS, PAIR_TERMS + 512)):
        block = np.sqrt(out[:, part])
        out[:, part] = block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
    if len(begin) > 1:
        again = (doc[1:] == doc[:-1]) & (word[1:] == word[:-1])
        out[:, -2] = np.bincount(doc[1:][again], minlength=n)
    distinct = np.bincount(np.unique(word * n + doc) % n, minlength=n) if n else np.zeros(0)
    out[:, -1] = words - distinct
    out[:, -2:] = out[:, -2:] / np.maximum(words, 1)[:, None]
    return out, words


@dataclass
class Model:
    """What is broadcast: term weights, the latent directions, and the labelled vectors."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, terms: np.ndarray) -> np.ndarray:
        v = (terms * self.weight) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A score from 0 to 1 for each text."""
        out = np.full(len(offsets) - 1, 0.5)
        for a, b in slices(offsets, SLICE_BYTES, SLICE_ROWS):
            terms, words = term_frequencies(np.ascontiguousarray(buf[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
            if len(self.labels):
                out[a:b] = self.vote(self.embed(terms))
            out[a:b][words == 0] = 0.0
        return out

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        k, out = min(NEIGHBOURS, len(self.labels)), np.zeros(len(vectors))
        for at in range(0, len(vectors), BLOCK):
            cosine = vectors[at : at + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            # A small floor, so that a text unlike all labelled ones still has its neighbours' mean.
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** 8
            out[at : at + BLOCK] = np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the bounded sample of labelled texts outside the held-out part."""
    spark = docs.sparkSession
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.avg(F.col("quality").cast("double")).alias("quality"))
        .select(F.col("doc_id").cast("long").alias("label_id"), (F.col("quality") >= 0.5).alias("good"))
    )
    # A label may be of a document that is not here, so the texts are met first, by id alone.
    ids = docs.select(F.col("doc_id").cast("long").alias("label_id")).where("label_id is not null").distinct()
    known = known.join(ids, "label_id", "left_semi")
    order = (F.xxhash64("label_id"), F.col("label_id"))
    sample = [tuple(r) for good in (True, False) for r in known.where(F.col("good") == good).orderBy(*order).limit(PER_CLASS).collect()]
    chosen = F.broadcast(spark.createDataFrame(sample, "label_id long, good boolean"))  # at most 2 * PER_CLASS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, SLICE_BYTES, SLICE_ROWS):
                terms, words = term_frequencies(np.ascontiguousarray(buf[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label_id"), part.column("good"), pa.array(words > 0), pa.array([x.tobytes() for x in terms], pa.binary())],
                    ["label_id", "good", "has_words", "terms"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), text_or_empty(F.col("text")).alias("text"))
    # Of rows that share a doc_id one text is learnt from, so the sample keeps its bound.
    texts = texts.join(chosen, "label_id").groupBy("label_id", "good").agg(F.max("text").alias("text"))
    rows = texts.mapInArrow(giving_back(run), "label_id long, good boolean, has_words boolean, terms binary").where("has_words").collect()
    rows.sort(key=lambda r: r.label_id)
    terms = np.array([np.frombuffer(r.terms, dtype=np.float32) for r in rows], dtype=np.float32).reshape(len(rows), N_TERMS)
    good = np.array([r.good for r in rows], dtype=np.float64)
    weight = np.log((1 + len(rows)) / (1 + (terms > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    weighted = (terms * weight).astype(np.float64)
    _, directions = np.linalg.eigh(weighted.T @ weighted)
    model = Model(weight, np.ascontiguousarray(directions[:, ::-1][:, :DIMENSIONS], dtype=np.float32), np.zeros((0, DIMENSIONS), np.float32), good)
    model.vectors = model.embed(terms)
    return model


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(*text_bytes(batch.column("text")))
            verdict = pa.array((score >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), verdict], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty(F.col("text")).alias("text"))
    return rows.mapInArrow(giving_back(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; only texts go to Python."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield pa.array(shared.value.scores(*text_bytes(text)))
        give_back()

    # As one struct, so columns may have any names.
    rows = docs.select(F.struct("*").alias("row"), text_or_empty(F.col("text")).alias("text"))
    return rows.where(score("text") >= THRESHOLD).select("row.*")
