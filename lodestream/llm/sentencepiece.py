"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton holds all pieces. Read once along the text, it reports at each position every piece
that ends there, the longest by its own state and the shorter ones by output links; each relaxes the
best score of its end from that of its start. A position that no one-character piece ends at can
also be reached by an unknown character, written as byte pieces where the model has them.

No piece of the model has a blank mark after another character, so the best path always passes
between a character and a blank mark that follows, and a text is cut there without changing the result;
line breaks are such cuts too where no longer piece holds one. The parts repeat much, and their results
are remembered in a bounded table.

For a unigram model the path with the greatest sum of scores wins. In a model trained as BPE a
score is the rank of a merge, and the pieces of a text are those that the merges leave. There a piece
relaxes its end only if the merges leave it and the piece before it as they are when the two are put
together; the best path of such pieces is the one the library gives.

A model is read from its file's bytes on the driver and broadcast (its size is checked).

Defined results: null texts count as empty and have no ids; decode(encode(t)) is t, but for the
blank mark U+2581, which is decoded as a blank as SentencePiece does; rows are independent, so ties,
repeated rows, null or shared doc_ids and further columns have no effect; an empty table gives an empty
result; a text of any length is encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.buffers import giving_back, keep
from lodestream.llm.text import text_or_empty
from lodestream.storage import bound_batches

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Parts a worker remembers in each of two generations, and pairs of pieces: some 120 MB and 60 MB.
MEMORY, PAIRS = 240_000, 500_000
MAX_DIFFER = 10_000
MAX_MODEL_BYTES = 64 << 20
MODEL_PATH = os.environ.get("LODESTREAM_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SLICE_CHARS = 1 << 20


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = buf[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(buf):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = buf[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = buf[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    """Pieces as (text, score, kind), and what the normaliser does."""

    pieces: list[tuple[str, float, int]]
    dummy_prefix: bool = True
    merges: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, dummy, merges = [], True, False
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                merges = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                dummy = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise NotImplementedError("only models that keep texts as they are, with blanks as marks")
        return cls(pieces, dummy, merges)


class _Memory(dict):
    """Results by part. A full generation becomes the old one, so what is still in use comes back cheaply."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = array("i", self.compute(part)).tobytes()
            if len(part) > 64:
                return ids
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids


class _Anything(dict):
    """Pieces that may follow what is no piece: all of them."""

    def get(self, key: int, default: bool = True) -> bool:
        return True


class Codec:
    """A model made ready to encode and decode; one for each worker process."""

    def __init__(self, model: Model) -> None:
        self.model = model
        live = [(p, s, i) for i, (p, s, k) in enumerate(model.pieces) if k in (NORMAL, USER_DEFINED) and p]
        self.score_of = {p: (s, i) for p, s, i in live}
        self.merge_score = {p: s for p, s, _ in live}
        self.sizes = [len(p) for p, _, _ in model.pieces]
        #: What is known of pieces after each piece; the last entry, number -1, is for those after none.
        self.follow: list[dict[int, bool]] = [*({} for _ in model.pieces), _Anything()]
        self.pairs = 0
        self.automaton = ahocorasick.Automaton()
        for p, s, i in live:
            # A piece that merges do not lead to can end no path of merges.
            if not model.merges or self.merge(p) == (i,):
                self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        normal = [s for _, s, k in model.pieces if k == NORMAL]
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), 0)
        bytes_ = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model.pieces) if k == BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        long = [p for p, _, _ in live if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in long):
            part = r"[\s\S]+"
        elif any("\n" in p for p in long):
            part = f"{BLANK}*[^{BLANK}]+|{BLANK}+"
        else:
            part = f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n"
        self.parts = re.compile(part)
        self.known = _Memory(self._part)
        #: Parts whose ids do not give them back; when there are too many to hold, whole texts are decoded.
        self.differ: set[str] = set()

    def merge(self, text: str) -> tuple[int, ...]:
        """Ids by replaying merges, best score first, leftmost first; -1 for an unknown character."""
        parts, score, none = list(text), self.merge_score.get, float("-inf")
        scores = [score(x + y, none) for x, y in zip(parts, parts[1:])]
        while scores and (most := max(scores)) != none:
            k = scores.index(most)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = score(parts[k] + parts[k + 1], none)
        return tuple(self.score_of[x][1] if x in self.score_of else -1 for x in parts)

    def _stays(self, left: int, right: int) -> bool:
        """Whether merges leave these two pieces, put together, as they are."""
        if (known := self.follow[left].get(right)) is None:
            if self.pairs >= PAIRS:
                for pieces in self.follow:
                    pieces.clear()
                self.pairs = 0
            text = self.model.pieces[left][0] + self.model.pieces[right][0]
            # Two pieces that make up a third are merged into it, if nothing else happens to them before.
            known = self.follow[left][right] = text not in self.merge_score and self.merge(text) == (left, right)
            self.pairs += 1
        return known

    def viterbi(self, text: str) -> tuple[int, ...]:
        """Ids of the best path through ``text``, which is normalised."""
        n, low, unknown = len(text), float("-inf"), self.unknown_score
        best, by = [low] * (n + 1), [-1] * (n + 1)
        best[0], at, single = 0.0, 0, False
        # ``at`` is the last position reached; it is settled when matches of a later one come.
        for last, (size, score, i) in self.automaton.iter(text):
            end = last + 1
            while at < end:
                if at and not single and best[at - 1] + unknown > best[at]:
                    best[at], by[at] = best[at - 1] + unknown, -1
                at, single = at + 1, False
            single = single or size == 1
            start = end - size
            total = best[start] + score
            if total > best[end]:
                best[end], by[end] = total, i
        while at <= n:
            if at and not single and best[at - 1] + unknown > best[at]:
                best[at], by[at] = best[at - 1] + unknown, -1
            at, single = at + 1, False
        return self._ids(text, by)

    def _ids(self, text: str, by: list[int]) -> tuple[int, ...]:
        """The pieces of a path, read back from its end; where it has none, an unknown character."""
        ids: list[int] = []
        n, sizes = len(text), self.sizes
        while n:
            if (i := by[n]) >= 0:
                ids.append(i)
                n -= sizes[i]
                continue
            n -= 1
            if self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(text[n].encode())]
            else:
                ids.append(self.unknown_id)
        ids.reverse()
        return tuple(ids)

    def merged(self, text: str) -> tuple[int, ...]:
        """Ids of the best path of pieces that merges leave side by side.

        The same pass: every piece that ends at a position, by its own state or an output link, relaxes that
        position's best score, unless merges would change it and the last piece of the path it goes on from.
        """
        n, low, unknown = len(text), float("-inf"), self.unknown_score
        stays, follow = self._stays, self.follow
        best, by = [low] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0

        def reach(at: int) -> None:
            """A position that no piece ends at is reached by an unknown character."""
            first = at
            while best[first - 1] == low:
                first -= 1
            for k in range(first, at + 1):
                best[k] = best[k - 1] + unknown

        for last, (size, score, i) in self.automaton.iter(text):
            end = last + 1
            start = end - size
            so_far = best[start]
            if so_far == low:
                reach(start)
                so_far = best[start]
            if so_far + score > best[end]:
                left = by[start]
                known = follow[left].get(i)
                if known or (known is None and stays(left, i)):
                    best[end], by[end] = so_far + score, i
        if best[n] == low:
            reach(n)
        return self._ids(text, by)

    def _part(self, text: str) -> tuple[int, ...]:
        ids = self.merged(text) if self.model.merges else self.viterbi(text)
        if len(self.differ) < MAX_DIFFER and self._text(ids) != text.replace(BLANK, " "):
            self.differ.add(text)
        return ids

    def encode(self, text: str) -> np.ndarray:
        return self.encode_checked(text)[0]

    def encode_checked(self, text: str) -> tuple[np.ndarray, bool]:
        """The ids of a text, and whether they give it back.

        A text is decoded part by part, as it is encoded: each part when its ids are found, and all of it where the
        ids of any of its parts do not give that back.
        """
        if not text:
            return np.zeros(0, dtype=np.int32), True
        marked = (" " + text if self.model.dummy_prefix else text).replace(" ", BLANK)
        parts = self.parts.findall(marked)
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, parts)), dtype=np.int32)
        if len(self.differ) < MAX_DIFFER and self.differ.isdisjoint(parts) and sum(map(len, parts)) == len(marked):
            return ids, True
        return ids, self.decode(ids) == text.replace(BLANK, " ")

    def _text(self, ids: Sequence[int]) -> str:
        if not hasattr(self, "piece_bytes"):
            self.piece_bytes = [
                bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(BLANK, " ").encode()
                for p, _, k in self.model.pieces
            ]
        return b"".join(map(self.piece_bytes.__getitem__, ids)).decode("utf-8", errors="replace")

    def decode(self, ids: np.ndarray) -> str:
        text = self._text(ids.tolist())
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _codec(shared) -> Codec:
    return keep(("codec", shared.id), lambda: Codec(shared.value))


class _Shared:
    """A broadcast model with a key for what a worker keeps."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as f:  # on the driver
            data = f.read(MAX_MODEL_BYTES + 1)
        if len(data) > MAX_MODEL_BYTES:
            raise ValueError(f"{path} is too large to broadcast")
        model = Model.parse(data)
        self.broadcast, self.id = spark.sparkContext.broadcast(model), hash(data)

    @property
    def value(self) -> Model:
        return self.broadcast.value


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back."""
    bound_batches(docs.sparkSession)
    shared = _Shared(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)

        def batch_of(doc_ids: list, ids: list[np.ndarray], same: list[bool]) -> pa.RecordBatch:
            size = np.array([len(x) for x in ids], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(size), lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])

        for batch in batches:
            held, chars = ([], [], []), 0
            for doc_id, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = value.as_py()
                ids, same = codec.encode_checked(text)
                held[0].append(doc_id.as_py())
                held[1].append(ids)
                held[2].append(same)
                chars += len(text)
                if chars >= SLICE_CHARS:
                    yield batch_of(*held)
                    held, chars = ([], [], []), 0
            if held[0]:
                yield batch_of(*held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    return rows.mapInArrow(giving_back(run), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(tokens: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id and text of each row of ids; null ids count as none."""
    shared = _Shared(tokens.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = [codec.decode(np.array(x.as_py() or [], dtype=np.int32)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(giving_back(run), "doc_id long, text string")
