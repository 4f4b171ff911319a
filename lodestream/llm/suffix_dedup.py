"""Removing repeated byte strings by bucket-pointer refinement.

Every suffix gets a bucket pointer. The pointers of q-grams are refined by pairing each with the pointer
at a later offset, the refined ones serving for the next round: 1, 2, 4 ... 32 bytes deep, then 100. A
pointer is a 64-bit number made from the pointers it pairs, so equal strings have equal pointers in
every task and no round has to renumber buckets across the cluster. Suffixes whose buckets agree to
depth 100 begin with the same 100 bytes; all but the first of such a bucket mark what they cover.

Suffixes are not sent one by one. Each is filed under the least 32-byte pointer within its first 100
bytes; neighbours filed under the same place form a run, some 35 suffixes long. Equal strings are
filed under equal pointers at the same distance, so they meet:

1. each task cuts its texts into runs with the run's bucket (the pointer filed under) and the run's own
   pointer, refined from those at later offsets; of runs equal in both only the first is sent on;
2. by bucket, runs are sorted by their own pointers; all but the first of equal runs are covered
   whole; if a bucket holds several kinds, the first of each goes on to be compared suffix by suffix;
3. texts meet the runs still open and send their bytes (in a bucket with very many, suffix pointers);
4. by bucket, the suffixes of open runs are sorted by pointer, document and place, and all but the
   first of equal ones are covered;
5. texts meet what is covered, and what is left is hashed.

Order is that of doc_id. Defined results: null texts count as empty; texts under 100 bytes lose
nothing; rows that share a doc_id, or have none (after all others), are ordered by a hash of their
texts, so of equal rows one is first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from lodestream.llm.buffers import text_bytes
from lodestream.llm.text import text_or_empty
from lodestream.storage import materialize

LENGTH, GRAM = 100, 32
#: Places of a 32-byte string in one of 100 bytes.
PLACES = LENGTH - GRAM + 1
#: Suffixes worked on at a time; places are kept in this many bits.
PIECE, PLACE_BITS = 1 << 20, 24
#: Buckets with more kinds of runs send pointers of suffixes, which spread over all tasks, not bytes.
MANY_KINDS = 5_000
#: Bytes of text for each part that runs and texts are dealt into.
PART_BYTES = 8 << 20

_U = np.uint64
_M = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _pair(a: np.ndarray, b: np.ndarray, m: np.uint64) -> np.ndarray:
    """The pointer of a bucket refined by the bucket at a later offset."""
    h = a * m
    h += b
    h ^= h >> _U(29)
    return h


_FIRST = _pair(np.arange(1, 257, dtype=_U) * _M[1], np.arange(257, 513, dtype=_U), _M[2]) * _M[0]


def gram_pointers(buf: np.ndarray) -> np.ndarray:
    """Pointers of depth 32, for each place where 32 bytes are left."""
    h, depth = _FIRST[buf], 1
    for m in _M[:5]:
        h, depth = _pair(h[:-depth], h[depth:], m), depth * 2
    h *= _M[5]
    h ^= h >> _U(32)
    return h


def suffix_pointers(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pointers of depth 100 at these places, from those of depth 32 at later offsets."""
    h = gram[at]
    for m, step in zip(_M, (GRAM, 2 * GRAM, LENGTH - GRAM), strict=False):
        h = _pair(h, gram[at + step], m)
    return h


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        key, span = np.minimum(key[:-span], key[span:]), 2 * span
    return np.minimum(key[: len(key) - (width - span)], key[width - span :]) if span < width else key


def cut_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place, length, bucket, pointer) of the runs in the texts; lengths count suffixes."""
    out: list[tuple[np.ndarray, ...]] = []
    for base in range(0, len(buf) - LENGTH + 1, PIECE):
        piece = buf[base : base + PIECE + LENGTH - 1]
        n = len(piece) - LENGTH + 1
        gram = gram_pointers(piece)
        key = (gram & ~_U((1 << PLACE_BITS) - 1)) | np.arange(len(gram), dtype=_U)
        least = _least(key, PLACES)
        whole = np.ones(n, dtype=bool)
        # A suffix is whole if its text does not end within it.
        a, b = np.searchsorted(offsets, [base + 1, base + n + LENGTH], side="left")
        for end in (offsets[a : b + 1] - base).tolist():
            whole[max(0, end - LENGTH + 1) : max(0, end)] = False
        new = np.ones(n, dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
        begin = np.flatnonzero(new & whole)
        if not len(begin):
            continue
        stop = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
        size = stop - begin + 1
        bucket = gram[(least[begin] & _U((1 << PLACE_BITS) - 1)).astype(np.int64)]
        last, pointer = stop + LENGTH - GRAM, size.astype(_U)
        for k in range((PLACES + LENGTH) // GRAM + 1):
            pointer = _pair(pointer, gram[np.minimum(begin + GRAM * k, last)], _M[k % len(_M)])
        doc = np.searchsorted(offsets, begin + base, side="right") - 1
        out.append((doc, begin + base - offsets[doc], size, bucket, pointer & _U((1 << 48) - 1)))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, _U, _U))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pack(key: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers ordered by key, as planes of bytes, which compress well."""
    order = np.lexsort((columns[0], key))
    rows = [np.diff(key[order], prepend=np.int64(0)), *(c[order] for c in columns)]
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in rows)
    return len(key).to_bytes(8, "little") + planes


def unpack(data: list[bytes], n_columns: int) -> list[np.ndarray]:
    """What ``pack`` packed, all blobs in a row, as signed numbers."""
    parts = []
    for blob in data:
        n = int.from_bytes(blob[:8], "little")
        columns = np.frombuffer(blob, dtype=np.uint8, offset=8, count=8 * n * n_columns).reshape(n_columns, 8, n)
        rows = [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in columns]
        parts.append([np.cumsum(rows[0]), *rows[1:]])
    return [np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else [()] * n_columns)]


def _dealt(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows by part."""
    order = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.diff(part[order], prepend=-1)) if len(part) else []
    for rows in np.split(order, bounds[1:]) if len(part) else []:
        yield int(part[rows[0]]), [c[rows] for c in columns]


COVERED, OPEN, OPEN_MANY = 0, 1, 2
SCHEMA = "part int, kind int, data binary"


def _by_part(df: DataFrame, n_parts: int) -> GroupedData:
    """Grouped by part, in a task for each, so that tasks stay small whatever the number set for shuffles."""
    return df.repartition(n_parts, "part").groupBy("part")


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by these keys (main key first), and flags of the rows that begin a new value of the first two."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        new[1:] = (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])
    return order, new


def _covered(key: np.ndarray, place: np.ndarray, size: np.ndarray, n_parts: int) -> list[tuple[int, int, bytes]]:
    return [(p, COVERED, pack(*c)) for p, c in _dealt(key % n_parts, key, place, size)]


def _phase1(texts: DataFrame, n_parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            doc, place, size, bucket, pointer = cut_runs(*text_bytes(batch.column("text")))
            key = keys[doc]
            order, first = _first_of(bucket, pointer, key, place)
            sent, again = order[first], order[~first]
            columns = key[sent], place[sent], size[sent], bucket[sent].view(np.int64), pointer[sent].view(np.int64)
            part = (bucket[sent] % _U(n_parts)).astype(np.int64)
            rows = [(p, OPEN, pack(*c)) for p, c in _dealt(part, *columns)]
            # Equal to an earlier run of the same batch: settled, and passed on as such.
            yield _batch(rows + [(p + n_parts, k, d) for p, k, d in _covered(key[again], place[again], size[again], n_parts)])

    return texts.select("key", "text").mapInArrow(run, SCHEMA)


def _phase2(runs: DataFrame, n_parts: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part >= n_parts:
            return _table([(part - n_parts, COVERED, x) for x in table.column("data").to_pylist()])
        key, place, size, bucket, pointer = unpack(table.column("data").to_pylist(), 5)
        order, first = _first_of(bucket, pointer, key, place)
        again, kinds = order[~first], order[first]
        # ``kinds`` is ordered by bucket; those alone in theirs are settled.
        _, back, count = np.unique(bucket[kinds], return_inverse=True, return_counts=True)
        out = _covered(key[again], place[again], size[again], n_parts)
        for kind, some in ((OPEN, (count[back] > 1) & (count[back] <= MANY_KINDS)), (OPEN_MANY, count[back] > MANY_KINDS)):
            left = kinds[some]
            out += [(p, kind, pack(*c)) for p, c in _dealt(key[left] % n_parts, key[left], place[left], size[left], bucket[left])]
        return _table(out)

    return _by_part(runs, 2 * n_parts).applyInArrow(run, SCHEMA)


def _blobs(table: pa.Table, kind: int) -> list[bytes]:
    return [d for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True) if k == kind]


def _ranges(size: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _pointers_of(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pointers of all suffixes of runs whose bytes lie one after the other."""
    begin = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
    return suffix_pointers(gram_pointers(data), np.repeat(begin, size) + _ranges(size))


def _phase3(texts: DataFrame, verdicts: DataFrame, n_parts: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if not right.num_rows or not left.num_rows:
            return _table(out)
        row_of = {k: i for i, k in enumerate(left.column("key").to_pylist())}
        texts_ = left.column("text").combine_chunks()
        buf, offsets = text_bytes(texts_ if isinstance(texts_, pa.Array) else texts_.chunk(0))
        for kind in (OPEN, OPEN_MANY):
            key, place, size, bucket = unpack(_blobs(right, kind), 4)
            if not len(key):
                continue
            at = offsets[np.fromiter(map(row_of.__getitem__, key.tolist()), dtype=np.int64, count=len(key))] + place
            if kind == OPEN:
                for p, (k, pl, n, b, a) in _dealt((bucket.view(_U) % _U(n_parts)).astype(np.int64), key, place, size, bucket, at):
                    order = np.lexsort((pl, k))
                    long = n[order] + LENGTH - 1
                    body = buf[np.repeat(a[order], long) + _ranges(long)]
                    out.append((p, kind, pack(k, pl, n, b) + body.tobytes()))
            else:
                long = size + LENGTH - 1
                pointer = _pointers_of(buf[np.repeat(at, long) + _ranges(long)], size)
                key, bucket, place = np.repeat(key, size), np.repeat(bucket, size), np.repeat(place, size) + _ranges(size)
                order, first = _first_of(pointer, bucket, key, place)
                again, sent = order[~first], order[first]
                part = (pointer[sent] % _U(n_parts)).astype(np.int64)
                columns = key[sent], place[sent], bucket[sent], pointer[sent].view(np.int64)
                out += [(p, kind, pack(*c)) for p, c in _dealt(part, *columns)]
                # Settled here; passed on beyond the parts, as in the first step.
                out += [(p + n_parts, k, d) for p, k, d in _covered(key[again], place[again], np.ones(len(again), np.int64), n_parts)]
        return _table(out)

    open_ = verdicts.where(F.col("kind") != COVERED)
    return _by_part(texts, n_parts).cogroup(_by_part(open_, n_parts)).applyInArrow(run, SCHEMA)


def _phase4(open_runs: DataFrame, n_parts: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part >= n_parts:
            return _table([(part - n_parts, COVERED, x) for x in table.column("data").to_pylist()])
        keys, places, buckets, pointers = [], [], [], []
        for blob in _blobs(table, OPEN):
            key, place, size, bucket = unpack([blob], 4)
            body = np.frombuffer(blob, dtype=np.uint8, offset=8 + 8 * 4 * len(key))
            keys.append(np.repeat(key, size))
            places.append(np.repeat(place, size) + _ranges(size))
            buckets.append(np.repeat(bucket, size))
            pointers.append(_pointers_of(body, size).view(np.int64))
        for blob in _blobs(table, OPEN_MANY):
            for held, c in zip((keys, places, buckets, pointers), unpack([blob], 4), strict=True):
                held.append(c)
        key, place, bucket, pointer = (np.concatenate(x) for x in (keys, places, buckets, pointers))
        order, first = _first_of(pointer, bucket, key, place)
        again = order[~first]
        again = again[np.lexsort((place[again], key[again]))]
        key, place = key[again], place[again]
        new = np.ones(len(again), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1] + 1)
        begin = np.flatnonzero(new)
        return _table(_covered(key[begin], place[begin], np.diff(np.append(begin, len(again))), n_parts))

    return _by_part(open_runs, 2 * n_parts).applyInArrow(run, SCHEMA)


def spans_of(place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that these suffixes cover with their first 100."""
    order = np.argsort(place, kind="stable")
    begin, end = place[order], np.maximum.accumulate(place[order] + size[order] + LENGTH - 1)
    new = np.append(True, begin[1:] > end[:-1]) if len(begin) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:] - 1, len(begin) - 1)] if len(first) else end


def _phase5(texts: DataFrame, covered: DataFrame, n_parts: int, with_spans: bool) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, place, size = unpack(right.column("data").to_pylist() if right.num_rows else [], 3)
        rows_of = {k: (pl, n) for k, (_, pl, n) in _dealt(key, key, place, size)} if len(key) else {}
        removed, spans, kept, total, begins, ends = [], [], [], [], [], []
        for k, text in zip(left.column("key").to_pylist(), left.column("text"), strict=True):
            data = text.as_py().encode()
            total.append(len(data))
            a, b = spans_of(*rows_of[k]) if k in rows_of else (np.zeros(0, np.int64),) * 2
            spans.append(len(a))
            removed.append(int((b - a).sum()))
            edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(data)]
            digest = hashlib.sha256()
            for x, y in zip(edges[::2], edges[1::2], strict=True):
                digest.update(data[x:y])
            kept.append(digest.hexdigest())
            begins.append(a.tolist())
            ends.append(b.tolist())
        columns = [left.column("doc_id").combine_chunks(), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_spans:
            columns += [pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
            names += ["span_begin", "span_end"]
        return pa.table(columns, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", span_begin array<long>, span_end array<long>" * with_spans
    return _by_part(texts, n_parts).cogroup(_by_part(covered, n_parts)).applyInArrow(run, schema)


def repeated_spans(docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; spans if asked for."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null or doc_id < 0").limit(1).count():
        # Ids in the order wanted, given out along a sort.
        ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        keyed = materialize(ordered.withColumn("key", F.monotonically_increasing_id()), "suffix-texts")
    else:
        keyed = rows.withColumn("key", F.col("doc_id"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // PART_BYTES) | 1
    texts = keyed.withColumn("part", F.pmod(F.col("key"), F.lit(n_parts)).cast("int"))
    verdicts = materialize(_phase2(_phase1(keyed, n_parts), n_parts), "suffix-verdicts")
    more = materialize(_phase4(_phase3(texts, verdicts, n_parts), n_parts), "suffix-covered")
    covered = verdicts.where(F.col("kind") == COVERED).unionByName(more)
    return _phase5(texts, covered, n_parts, with_spans)
