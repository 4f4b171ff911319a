"""Near copies: texts whose sets of five-word shingles have a similarity (Jaccard) of 4/5 or more.

SimHash comes first: a set's fingerprint of 64 bits is the majority of its shingles' bits, fingerprints that
differ in 4 bits at most meet in the byte-position index of ``simhash`` (count filter, verification by bits), and the
links it gives are held against the shingle sets. Copies near 0.8 differ in more bits than that, so what
fingerprints do not connect is searched for exactly, and pairs that they do connect are not verified again.

That search: shingles are put in one order for all texts; two sets of sizes m and n that are alike
share one among the first n // 5 + 1 of either, so those are posted. Where the first shared one stands
at i and j, at most min(m - i, n - j) are shared, and 4/9 of m + n must be. The order is that of hashes,
but takes shingles that many posted lists hold (counted over all texts) last, which keeps posting lists
short; what it is has no effect on the pairs found.

Pairs that meet in a list are candidates. Each is first held against a bound: a set is drawn as a map of
4 n to 8 n bits, and every bit of one that the other lacks is a shingle they do not share. What passes is
verified on the shingle sets themselves (64-bit hashes), which are made again from the texts for those
few documents alone. Sets are never written or shuffled for all documents, only their maps and the
posted part.

Lists longer than ``LONG_LIST`` are searched in two rounds: members first meet a few others only; those
that verified links do not connect then meet in full, so no member is lost by a link that fails. For that
lists go where the list's least node goes, with the sets of their members, so that lists of one family meet
in one task: pairs are held against the bound and verified there, and only links that connect something are
given. Lists of more than ``BLOCK`` members are dealt out in blocks, each of which meets those outside the
largest component, so no task holds a list whole.

Defined results: null texts count as empty; texts of no words form a group; a text shorter than a shingle
is one shingle; rows that share doc_id and text stay or go together; a null doc_id comes after all
others; an empty table gives an empty result; further columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestream.llm.buffers import LOWER, giving_back, hash_words, slices, text_bytes
from lodestream.llm.simhash import candidate_links, connected_components, label_nodes, least_rows
from lodestream.llm.text import text_or_empty
from lodestream.storage import bound_batches, materialize, scratch

NEAR_WORDS = 5
#: Bits that fingerprints may differ in; the index guarantees to find no more.
NEAR_BITS = 4
#: Posted lists that make a shingle common; common shingles at most, which bounds what is broadcast.
COMMON_LEAST, COMMON_MOST = 4, 500_000
#: Nodes up to this number (16 bytes each) are sent to the texts; beyond it both sides shuffle.
SENT_NODES = 1_000_000
#: Posting lists above this length are searched in two rounds; members that others meet in the first.
LONG_LIST, HUBS = 64, 2
#: Members of a block of a list, two of which meet in a task; pairs held against the bound at once.
BLOCK, CHECKED = 2048, 4096
#: Pairs held at a time; texts turned into shingles at a time, in bytes; postings in a task.
PAIRS, SLICE, ROWS_PER_TASK = 200_000, 1 << 20, 400_000
_U = np.uint64
_MULTIPLIERS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LINKS = "u long, v long, key long, n int, at int"


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, one text after the other, and how many each has."""
    n = len(offsets) - 1
    doc, word = hash_words(LOWER[buf], offsets)
    words = np.bincount(doc, minlength=n)
    parts = [word * m for m in _MULTIPLIERS]
    if len(word) >= NEAR_WORDS:
        at = np.flatnonzero(doc[: 1 - NEAR_WORDS] == doc[NEAR_WORDS - 1 :])
        h = sum((p[at + k] for k, p in enumerate(parts)), start=np.zeros(len(at), dtype=_U))
        owner = doc[at]
    else:
        h, owner = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    begin = np.cumsum(words) - words
    short = np.flatnonzero((words > 0) & (words < NEAR_WORDS))
    if len(short):  # the whole text is one shingle, told apart by its length
        one = words[short].astype(_U)
        for k in range(NEAR_WORDS - 1):
            held = words[short] > k
            one[held] += parts[k][begin[short[held]] + k]
        h, owner = np.concatenate([h, one]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    h ^= h >> _U(31)
    h *= _MULTIPLIERS[1]
    h ^= h >> _U(29)
    edges = np.searchsorted(owner, np.arange(n + 1)).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=n)


def _ends(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with their shingles, sizes and a hash of each set, a slice of texts at a time."""
    for batch in batches:
        buf, offsets = text_bytes(batch.column("text"))
        for a, b in slices(offsets, SLICE):
            h, size = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ends = _ends(size).tolist()
            node = np.array([xxhash.xxh64_intdigest(h[x:y].tobytes()) for x, y in zip(ends, ends[1:], strict=False)], dtype=_U)
            yield batch.slice(a, b - a), h, size, node.view(np.int64)


def _lists(ends: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))


def fingerprints(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The SimHash of each set: a bit is set if it is in over half of the shingles; zero for an empty set."""
    out = np.zeros(len(size), dtype=_U)
    some = size > 0
    if some.any():
        start, half = _ends(size)[:-1][some], size[some]
        for b in range(64):
            tally = np.add.reduceat((h >> _U(b) & _U(1)).view(np.int64), start)
            out[some] |= (2 * tally > half).astype(_U) << _U(b)
    return out.view(np.int64)


def map_width(n: int) -> int:
    """Bits of a set's map, as a power of two: the greatest up to 8 n."""
    return max(6, (8 * n).bit_length() - 1)


def bit_map(shingles: np.ndarray) -> bytes:
    width = map_width(len(shingles))
    bits = np.zeros(1 << width, dtype=bool)
    bits[(shingles >> _U(64 - width)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


#: A byte of a map of half the width has a bit for every two neighbours in two bytes.
_HALF = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 4, 2).max(axis=2), axis=1)[:, 0]


def halve(maps: np.ndarray) -> np.ndarray:
    """Maps, one a row, at half their width."""
    half = _HALF[maps]
    return half[:, ::2] | half[:, 1::2] >> 4


class _Maps:
    """Maps of sets, to hold pairs of them against the bound. Sizes of a pair differ by 5/4 at most, and
    their widths by one step."""

    def __init__(self, n: np.ndarray, maps: list[bytes]) -> None:
        self.n, size = n.astype(np.int64), np.fromiter(map(len, maps), dtype=np.int64, count=len(maps))
        self.size, self.row, self.held, self.halved = size, np.zeros(len(n), dtype=np.int64), {}, {}
        for w in np.unique(size).tolist():
            rows = np.flatnonzero(size == w)
            self.row[rows] = np.arange(len(rows))
            self.held[w] = np.frombuffer(b"".join(maps[i] for i in rows.tolist()), dtype=np.uint8).reshape(-1, w)

    def _at(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Maps of these rows, all of one width, at this or half that."""
        own = int(self.size[rows[0]])
        if own > width and own not in self.halved:
            self.halved[own] = halve(self.held[own])
        table = (self.halved if own > width else self.held)[own]
        return table[self.row[rows]].view(np.uint64)

    def can_be_alike(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether the maps at these rows allow a similarity of 0.8."""
        out = np.zeros(len(u), dtype=bool)
        shape = self.size[u] << 32 | self.size[v]
        for s in np.unique(shape).tolist():
            a, b = s >> 32, s & (1 << 32) - 1
            if max(a, b) > 2 * min(a, b):
                continue
            all_ = np.flatnonzero(shape == s)
            for some in np.array_split(all_, len(all_) * min(a, b) // (4 << 20) + 1):
                x, y = self._at(u[some], min(a, b)), self._at(v[some], min(a, b))
                m, n = self.n[u[some]], self.n[v[some]]
                only_x = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
                only_y = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
                out[some] = 9 * np.minimum(m - only_x, n - only_y) >= 4 * (m + n)
        return out


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def with_maps(texts: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (the set's hash), n, map, print (its fingerprint), and keys: its least n // 5 + 1 shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, size, node in _in_slices(batches):
            ends = _ends(size)
            keys = np.minimum(size // 5 + 1, size)
            at = np.arange(len(h)) - np.repeat(ends[:-1], size)
            maps = [bit_map(h[a:b]) for a, b in zip(ends.tolist(), ends.tolist()[1:], strict=False)]
            columns = [part.column("doc_id"), part.column("text_hash"), pa.array(node), pa.array(size.astype(np.int32)), pa.array(maps, pa.binary())]
            columns += [pa.array(fingerprints(h, size)), _lists(_ends(keys), h[at < np.repeat(keys, size)])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "n", "map", "print", "keys"])

    return texts.mapInArrow(giving_back(run), "doc_id long, text_hash long, node long, n int, map binary, print long, keys array<long>")


def common_shingles(maps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several lists of keys hold, ascending, and how many; the most frequent ones, if too many."""
    counts = maps.select(F.explode("keys").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    table = counts.where(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).toArrow()
    shingle, n = (table.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(shingle.view(_U))
    return shingle.view(_U)[order], n[order]


def postings(texts: DataFrame, common: np.ndarray, times: np.ndarray) -> DataFrame:
    """(key, node, n, at): the first n // 5 + 1 shingles of each set, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, size, node in _in_slices(batches):
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(h)) - np.repeat(_ends(size)[:-1], size)
            if len(common) and len(h):
                found = np.minimum(np.searchsorted(common, h), len(common) - 1)
                rank = np.where(common[found] == h, times[found], 0)
                if rank.any():
                    h = h[np.argsort(row << 32 | rank, kind="stable")]
            keep = at <= size[row] // 5
            columns = [h[keep].view(np.int64), node[row[keep]], size[row[keep]].astype(np.int32), at[keep].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n", "at"])

    return texts.select("text").mapInArrow(giving_back(run), "key long, node long, n int, at int")


def _cuts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most``, by the running sum of what the rows hold."""
    at = np.flatnonzero(np.diff(ends // most, prepend=0, append=-1)).tolist()
    return zip([0, *at[:-1]], at, strict=True)


class _Lists:
    """Posting lists of one task, by key, size and node."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches)
        key, node, n = (table.column(c).to_numpy() for c in ("key", "node", "n"))
        order = np.lexsort((node, n, key))
        key, node = key[order], node[order]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        order, self.key, self.node = order[first], key[first], node[first]
        self.n, self.at = n[order].astype(np.int64), table.column("at").to_numpy()[order].astype(np.int64)
        self.root = table.column("root").to_numpy()[order] if "root" in table.column_names else None
        start = np.concatenate([[True], self.key[1:] != self.key[:-1]])
        self.edge = np.flatnonzero(start)
        self.length = np.diff(np.append(self.edge, len(self.key)))
        self.place = (np.cumsum(start) - 1) << 32 | self.n
        #: The most shingles a set may have that is alike and meets this one here first.
        self.most = (5 * self.n - 9 * self.at) // 4

    def pairs(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the rows x with the rows y (ascending) of their lists that can be alike, greater
        node first; if both are the same rows, each pair once."""
        base = self.place[x] >> 32 << 32
        low = np.searchsorted(self.place[y], base | -(-4 * self.n[x] // 5))
        high = np.searchsorted(self.place[y], base | np.minimum(self.most[x], 5 * self.n[x] // 4), side="right")
        if x is y:
            high = np.minimum(high, np.arange(len(x)))
        count = np.maximum(high - low, 0)
        for a, b in _cuts(np.cumsum(count), PAIRS):
            c = count[a:b]
            i = np.repeat(x[a:b], c)
            j = y[np.repeat(low[a:b] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            hit = (self.n[i] <= self.most[j]) & (self.node[i] != self.node[j])
            if self.root is not None:
                hit &= self.root[i] != self.root[j]
            i, j = self.node[i[hit]], self.node[j[hit]]
            if len(i):
                yield np.maximum(i, j), np.minimum(i, j)

    def first_round(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of short lists; of long ones those with their hubs, and neighbours by size."""
        long = np.repeat(self.length, self.length) > LONG_LIST
        short = np.flatnonzero(~long)
        yield from self.pairs(short, short)
        rows = np.flatnonzero(long)
        by_node = rows[np.lexsort((self.node[rows], self.place[rows] >> 32))]
        of = self.place[by_node] >> 32
        hubs = np.sort(by_node[np.arange(len(rows)) - np.searchsorted(of, of) < HUBS])
        yield from self.pairs(rows, hubs)
        i = rows[1:][self.place[rows[1:]] >> 32 == self.place[rows[:-1]] >> 32]
        j = i - 1
        hit = (5 * self.n[j] >= 4 * self.n[i]) & (self.n[i] <= self.most[j]) & (self.n[j] <= self.most[i])
        i, j = self.node[i[hit]], self.node[j[hit]]
        yield np.maximum(i, j), np.minimum(i, j)

    def _mixed(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Lists that verified links do not connect: rows, component of each row, sizes of components."""
        low, high = (f.reduceat(self.root, self.edge) for f in (np.minimum, np.maximum))
        mixed = low != high
        for at, length in zip(self.edge[mixed].tolist(), self.length[mixed].tolist(), strict=True):
            rows = np.arange(at, at + length)
            _, of, size = np.unique(self.root[rows], return_inverse=True, return_counts=True)
            yield rows, of, size

    def second_round(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of members that verified links do not connect: component by component, the
        largest first, against those that are left, so members of one are not compared."""
        for rows, of, size in self._mixed():
            for c in np.argsort(-size, kind="stable").tolist():
                if size[c] <= LONG_LIST:
                    break
                yield from self.pairs(rows[of != c], rows[of == c])
                rows, of = rows[of != c], of[of != c]
            yield from self.pairs(rows, rows)


def _unique(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs without repeats, as far as they are held together."""
    held, size = [], 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        u, v = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.zeros(0, dtype=bool)
        return u[new], v[new]

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > 2 * PAIRS:
            held = [out()]
            size = len(held[0][0])
            if size > PAIRS:
                yield held.pop()
                size = 0
    if held:
        yield out()


class _Sets:
    """The sets of one task's members, and what is known of their components."""

    def __init__(self, node: np.ndarray, ends: np.ndarray, flat: np.ndarray) -> None:
        self.node, one = np.unique(node, return_index=True)
        self.shingles = [flat[ends[i] : ends[i + 1]] for i in one.tolist()]
        size = np.fromiter(map(len, self.shingles), dtype=np.int64, count=len(one))
        self.maps = _Maps(size, [bit_map(x) for x in self.shingles])

    def alike(self, u: int, v: int) -> bool:
        a, b = self.shingles[u], self.shingles[v]
        if len(a) > len(b):
            a, b = b, a
        shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 9 * shared >= 4 * (len(a) + len(b))

    def connecting(self, pairs: Iterator[tuple[np.ndarray, np.ndarray]], node: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that are alike and connect what the roots of nodes and earlier ones do not."""
        label = np.zeros(len(self.node), dtype=np.int64)
        label[np.searchsorted(self.node, node)] = np.unique(root, return_inverse=True)[1]
        us, vs = [], []
        for u, v in pairs:
            for at in range(0, len(u), CHECKED):
                x, y = (np.searchsorted(self.node, z[at : at + CHECKED]) for z in (u, v))
                open_ = label[x] != label[y]
                x, y = x[open_], y[open_]
                can = self.maps.can_be_alike(x, y)
                for i, j in zip(x[can].tolist(), y[can].tolist(), strict=True):
                    if label[i] != label[j] and self.alike(i, j):
                        label[label == label[i]] = label[j]
                        us.append(self.node[i])
                        vs.append(self.node[j])
        return np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64)


def _batch(u: np.ndarray, v: np.ndarray | None, key: np.ndarray | None, n: np.ndarray | None, at: np.ndarray | None) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    columns = [pa.nulls(len(u), t) if c is None else pa.array(c).cast(t) for c, t in zip((u, v, key, n, at), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["u", "v", "key", "n", "at"])


def first_candidates(posted: DataFrame, n_posted: int) -> DataFrame:
    """Candidate links (u, v), u > v, and the members (u, key, n, at) of long lists, with v null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held) < 2:
            return
        lists = _Lists(held)
        held.clear()
        for u, v in _unique(lists.first_round()):
            yield _batch(u, v, None, None, None)
        long = np.repeat(lists.length, lists.length) > LONG_LIST
        if long.any():
            yield _batch(lists.node[long], None, lists.key[long], lists.n[long], lists.at[long])

    tasks = max(int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_posted // ROWS_PER_TASK + 1)
    return posted.repartition(tasks, "key").mapInArrow(giving_back(run), _LINKS)


def mixed_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members, with their roots, of the lists that ``links`` leave in several components, and p: where they meet."""
    with scratch(members.sparkSession):
        rooted = members.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = materialize(rooted, "near-rooted")
        roots = rooted.groupBy("key", "root").agg(F.count("*").alias("m"), F.min("node").alias("least"))
        lists = roots.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("big"), F.sum("m").alias("m"), F.max("m").alias("most"), F.min("least").alias("least"))
        lists = lists.where("most < m").selectExpr("key", "least", "big", f"m div {BLOCK} + 1 AS b", f"m - most <= {BLOCK} AS few")
        # Where few are outside the largest component, they go to each block of it; else pairs of blocks meet.
        mixed = rooted.join(lists, "key").withColumn("i", F.expr("pmod(xxhash64(node), b)"))
        mixed = mixed.withColumn("j", F.explode(F.expr("CASE WHEN few AND root = big THEN array(i) ELSE sequence(0L, b - 1L) END")))
        mixed = mixed.withColumn("i", F.expr("CASE WHEN few THEN j ELSE i END"))
        where = F.xxhash64("least", F.least("i", "j"), F.greatest("i", "j"))
        mixed = mixed.withColumn("p", where).withColumn("key", F.xxhash64("p", "key"))
        return materialize(mixed.select("p", "key", "node", "n", "at", "root").distinct(), "near-members", keep=True)


def second_links(texts: DataFrame, distinct: DataFrame, mixed: DataFrame) -> DataFrame:
    """Links (u, v) of similarity 0.8 or more that connect members not connected yet."""
    schema = "p long, key long, node long, n int, at int, root long, shingles array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        is_set = table.column("key").is_null()
        own = table.filter(is_set)
        shingles = own.column("shingles").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(shingles.value_lengths().to_numpy().astype(np.int64))])
        sets = _Sets(own.column("node").to_numpy(), ends, shingles.flatten().to_numpy().view(_U))
        lists = _Lists(table.filter(pa.compute.invert(is_set)).drop_columns(["shingles"]).to_batches())
        u, v = sets.connecting(_unique(lists.second_round()), lists.node, lists.root)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    with scratch(texts.sparkSession):
        nodes = mixed.select("node").distinct()
        rows = distinct.join(nodes, "node", "left_semi").select("first.doc_id", "first.text_hash")
        sets = materialize(sets_of(texts, rows), "member-sets")
        none = F.lit(None)
        sent = mixed.select("p", "node").distinct().join(sets, "node")
        sent = sent.select("p", none.alias("key"), "node", none.alias("n"), none.alias("at"), none.alias("root"), "shingles")
        dealt = mixed.withColumn("shingles", none).unionByName(sent).to(StructType.fromDDL(schema))
        tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), mixed.count() // (ROWS_PER_TASK // 8) + 1)
        return materialize(dealt.repartition(tasks, "p").mapInArrow(giving_back(run), "u long, v long"), "second-links", keep=True)


def possible_links(maps: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate links that the sets' maps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n_u", "n_v")])
            both = _Maps(n, batch.column("map_u").to_pylist() + batch.column("map_v").to_pylist())
            rows = np.arange(batch.num_rows)
            yield batch.select(["u", "v"]).filter(pa.array(both.can_be_alike(rows, rows + batch.num_rows)))

    links = candidates
    for end in ("u", "v"):
        links = links.join(maps.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("map").alias(f"map_{end}")), end)
    return materialize(links.select("u", "v", "n_u", "map_u", "n_v", "map_v").mapInArrow(giving_back(run), "u long, v long"), "possible-links")


def sets_of(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, shingles) of the documents in ``rows`` (doc_id, text_hash), one of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, size, node in _in_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(node), _lists(_ends(size), h)], ["node", "shingles"])

    rows = materialize(rows.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")), "wanted-rows")
    side = F.broadcast(rows) if rows.count() <= SENT_NODES else rows
    wanted = texts.join(side, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi")
    return wanted.select("text").mapInArrow(giving_back(run), "node long, shingles array<long>").dropDuplicates(["node"])


def verified_links(texts: DataFrame, distinct: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate links (u, v) of similarity 0.8 or more, all held against the shingle sets."""
    with scratch(texts.sparkSession):
        candidates = materialize(candidates.distinct(), "candidates")
        nodes = materialize(candidates.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "candidate-nodes")
        known = materialize(distinct.join(nodes, "node", "left_semi").select("node", "n", "map", "first"), "candidate-maps")
        links = possible_links(known, candidates)
        nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        rows = known.join(nodes, "node", "left_semi").select("first.doc_id", "first.text_hash")
        sets = materialize(sets_of(texts, rows), "wanted-sets")
        for end in ("u", "v"):
            links = links.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"of_{end}")), end)
        shared = F.size(F.array_intersect("of_u", "of_v"))
        alike = 9 * shared >= 4 * (F.size("of_u") + F.size("of_v"))
        return materialize(links.where(alike).select("u", "v"), "near-links", keep=True)


def fingerprint_links(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links (u, v), u > v, of similarity 0.8 or more among those of sets whose fingerprints differ in
    ``NEAR_BITS`` at most: the index's links join the least node of either fingerprint, to which the others of it go."""
    prints = materialize(distinct.groupBy("print").agg(F.min("node").alias("least")), "near-prints")
    same = distinct.join(prints, "print").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    links = candidate_links(prints.select(F.col("print").alias("node")), NEAR_BITS)
    for end in ("u", "v"):
        links = links.join(prints.select(F.col("print").alias(end), F.col("least").alias(f"node_{end}")), end)
    between = links.select(F.greatest("node_u", "node_v").alias("u"), F.least("node_u", "node_v").alias("v"))
    return verified_links(texts, distinct, same.unionByName(between))


def _unconnected(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """The candidate links (u, v) whose ends ``links`` do not connect."""
    roots = materialize(connected_components(links), "print-roots")
    for end in ("u", "v"):
        candidates = candidates.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return candidates.where("coalesce(root_u, u) <> coalesce(root_v, v)").select("u", "v")


def near_links(texts: DataFrame, maps: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links (u, v), u > v, of similarity 0.8 or more that connect all nodes that such links connect: those that
    fingerprints find, then the rest."""
    found = fingerprint_links(texts, distinct)
    n_posted = maps.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    posted = postings(texts, *common_shingles(maps))
    first = materialize(first_candidates(posted, n_posted), "first-candidates")
    rest = _unconnected(first.where("v IS NOT NULL").select("u", "v"), found)
    links = found.unionByName(verified_links(texts, distinct, rest))
    members = first.where("v IS NULL").select("key", F.col("u").alias("node"), "n", "at")
    mixed = mixed_members(members, links)
    if mixed.isEmpty():
        return links
    return links.unionByName(second_links(texts, distinct, mixed))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of each group the one with the smallest doc_id.

    Groups are what links of similarity 0.8 or more connect.
    """
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        texts = _texts(docs)
        maps = materialize(with_maps(texts), "set-maps")
        distinct = materialize(least_rows(maps.drop("keys"), ["n", "map", "print"], ["doc_id", "text_hash"]), "distinct-sets")
        labelled = label_nodes(maps.select("doc_id", "text_hash", "node"), distinct, near_links(texts, maps, distinct))
        gone = labelled.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))))
        gone = materialize(gone.select(F.col("doc_id").alias("id"), "text_hash").distinct(), "near-copies", keep=True)
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text_or_empty(F.col("text"))).alias("own_hash"))
    stay = keyed.join(gone, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left_anti")
    return stay.select("row.*")
