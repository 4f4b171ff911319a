"""A column of texts as one buffer of UTF-8 bytes, worked on by arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are analysed in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

SPACE_BYTE = np.zeros(256, dtype=bool)
SPACE_BYTE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


#: What this worker keeps for its next tasks, and what of it the present one has asked for.
_kept: dict[Hashable, Any] = {}
_asked: set[Hashable] = set()


def keep(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives; made once for a worker, as long as each of its tasks asks for it."""
    _asked.add(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Returns what this worker has freed to the system, and what its task has not asked for; workers live on after their tasks."""
    for key in _kept.keys() - _asked:
        del _kept[key]
    _asked.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Run) -> Run:
    """``run``, giving memory back when a task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def slices(offsets: np.ndarray, most: int, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, at + most_rows, n)
        yield at, to
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and each string's bounds in them."""
    array = column.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def encode_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """For each word: where it begins, its document, and itself, encoded by a dictionary."""
    space = SPACE_BYTE[buf]
    before = np.concatenate([[True], space[:-1]])
    before[offsets[:-1][offsets[:-1] < len(buf)]] = True
    begin = np.flatnonzero(~space & before)
    doc = np.searchsorted(offsets, begin, side="right") - 1
    letters = buf[~space]
    ends = np.append(begin - np.searchsorted(np.flatnonzero(space), begin), len(letters)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return begin, doc, words.dictionary_encode()


def number_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: where it begins, its document, and its number; equal words, equal numbers."""
    begin, doc, words = encode_words(buf, offsets)
    return begin, doc, words.indices.to_numpy().astype(np.int64)


def hash_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word: its document, and a 64-bit hash of its bytes, the same in every task."""
    _, doc, words = encode_words(buf, offsets)
    known = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary))
    return doc, known[words.indices.to_numpy()]
