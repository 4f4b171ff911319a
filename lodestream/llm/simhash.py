"""SimHash near-dedup by a byte-position inverted index with count filtering.

Two fingerprints of 64 bits that differ in at most d of them share at least 8 - d of their 8 byte
positions. The index posts each distinct fingerprint under the bytes at three positions at a time; the
20 triples of ``TRIPLES`` are such that any four shared positions hold one of them whole, so with d <= 4
no pair is missed. Fingerprints that meet in a posting list are tallied on all their byte positions, pairs
below the guaranteed number of matches are dropped, and the rest are verified by their differing bits.

Lists longer than ``HOT_LIST`` are split: their members are posted again under the byte at one further
position at a time, each of the five. A pair within the limit shares a fourth position, so it still meets.
Lists are counted before anything is gathered, so no list of more members reaches a task unsplit.

A posting list gives a spanning forest of its links, never all pairs: short lists are compared in
blocks, long ones by a search that takes each fingerprint out once it is reached, so a dense group
costs about one comparison a member. Forests are merged within a task, then joined into components
by alternating large-star and small-star rounds over the links, which stay distributed.

Defined results: null texts count as empty; a text of no words has the fingerprint zero, linked like
any other; a text shorter than a shingle is one shingle; equal texts share a fingerprint; null doc_ids
never become a component's id unless it has no other; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.buffers import giving_back
from lodestream.llm.text import text_or_empty
from lodestream.storage import bound_batches, materialize

SEED = 42
#: Shingles held at a time while tallying bits, so a very long text needs no more memory.
CHUNK = 1 << 15
#: Posting lists up to this length are compared in blocks.
SHORT_LIST = 24
#: Posting lists above this length are split by a further position; keys of such lists that are broadcast.
HOT_LIST, SENT_KEYS = 512, 1_000_000
ROWS_PER_TASK = 1_000_000


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of 0..7 such that any four positions hold one whole (Turan's construction).

    Positions fall in three classes; a triple is taken if it lies in one class, or has two members
    in a class and one in the next.
    """
    cls = [0, 0, 0, 1, 1, 1, 2, 2]

    def taken(t: tuple[int, ...]) -> bool:
        n = [sum(cls[i] == c for i in t) for c in range(3)]
        return 3 in n or any(n[c] == 2 and n[(c + 1) % 3] == 1 for c in range(3))

    return [t for t in combinations(range(8), 3) if taken(t)]


TRIPLES = covering_triples()


def shingle_hashes(text: bytes, shingle_words: int) -> Iterator[tuple[np.ndarray, int]]:
    """Hashes of a text's shingles in chunks, each with the number of all; bytes split and fold as ASCII does."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle_words, len(words))
    start, end = (end - size)[: len(words) - k + 1], end[k - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(start), CHUNK):
        spans = zip(start[at : at + CHUNK].tolist(), end[at : at + CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8"), len(start)


def fingerprint(text: bytes, shingle_words: int) -> int:
    """A text's fingerprint; zero for a text of no words."""
    tally, n = np.zeros(64, dtype=np.int64), 0
    for h, n in shingle_hashes(text, shingle_words):
        tally += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * tally > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id and node, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle_words) for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, dtype="<u8").view("<i8"))], ["doc_id", "node"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    return rows.mapInArrow(giving_back(run), "doc_id long, node long")


def _near(a: np.ndarray, b: np.ndarray, least: int, most: int) -> np.ndarray:
    """Count filter, then verification, of fingerprints: shared byte positions, differing bits."""
    x = np.ascontiguousarray(a ^ b)
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    return (shared >= least) & (np.bitwise_count(x) <= most)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member of its component) that connect what the links u-v connect."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    member = label != np.arange(len(nodes))
    return nodes[member], nodes[label[member]]


def _links(key: np.ndarray, node: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links found in the posting lists of one task."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fp = node.view("<u8")
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(edge, len(key)))
    size = np.repeat(length, length)
    us, vs = [], []
    for lag in range(1, SHORT_LIST):
        i = np.flatnonzero((key[:-lag] == key[lag:]) & (size[:-lag] <= SHORT_LIST)) if lag < len(key) else []
        if not len(i):
            break
        for part in np.array_split(i, len(i) // 200_000 + 1):
            hit = part[_near(fp[part], fp[part + lag], least, most)]
            us.append(node[hit])
            vs.append(node[hit + lag])
    for at, n in zip(edge[length > SHORT_LIST].tolist(), length[length > SHORT_LIST].tolist(), strict=True):
        # From the least node on: lists of one dense group then mostly give the same links.
        left = np.arange(at, at + n)
        while len(left):
            reached, left = [left[0]], left[1:]
            while reached and len(left):
                i = reached.pop()
                near = np.concatenate([_near(fp[i], fp[p], least, most) for p in np.array_split(left, len(left) // 200_000 + 1)])
                us.append(node[left[near]])
                vs.append(np.full(int(near.sum()), node[i]))
                reached += left[near].tolist()
                left = left[~near]
    none = np.zeros(0, dtype=np.int64)
    return forest(np.concatenate([none, *us]), np.concatenate([none, *vs]))


def posting_keys() -> list[str]:
    """SQL for the keys of a fingerprint ``node``: the number of a triple and the bytes there."""
    return [
        f"shiftleft({n}L, 24) | shiftleft({_byte(a)}, 16) | shiftleft({_byte(b)}, 8) | {_byte(c)}"
        for n, (a, b, c) in enumerate(TRIPLES)
    ]


def _byte(i: int) -> str:
    return f"(shiftrightunsigned(node, {8 * i}) & 255L)"


def split_keys(posted: DataFrame, hot: DataFrame) -> DataFrame:
    """Postings under hot keys are posted under these and the byte at each further position instead."""
    further = ", ".join(
        f"CASE WHEN shiftright(key, 24) NOT IN ({', '.join(str(n) for n, t in enumerate(TRIPLES) if p in t)}) "
        f"THEN key | shiftleft({p + 1}L, 32) | shiftleft({_byte(p)}, 40) END"
        for p in range(8)
    )
    side = hot.select(F.col("key").alias("hot_key"))
    side = F.broadcast(side) if hot.count() <= SENT_KEYS else side
    keys = F.expr(f"CASE WHEN hot_key IS NULL THEN array(key) ELSE array_compact(array({further})) END")
    return posted.join(side, F.col("key") == F.col("hot_key"), "left").select(F.explode(keys).alias("key"), "node")


def candidate_links(nodes: DataFrame, max_diff: int, hot_list: int = HOT_LIST) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints, found and verified task by task; see ``_links``."""
    if max_diff > 4:
        raise ValueError("the triples guarantee a shared one for up to 4 differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held) < 2:
            return
        table = pa.Table.from_batches(held)
        u, v = _links(table.column("key").to_numpy(), table.column("node").to_numpy(), 8 - max_diff, max_diff)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    posted = nodes.select(F.explode(F.array(*map(F.expr, posting_keys()))).alias("key"), "node")
    lists = posted.groupBy("key").agg(F.count("*").alias("n"))
    lists = materialize(lists.where(F.col("n") > hot_list), "hot-lists")
    n_posted = nodes.count() * len(TRIPLES) + (lists.agg(F.sum("n")).first()[0] or 0) * 4
    if not lists.isEmpty():
        posted = split_keys(posted, lists)
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_posted // ROWS_PER_TASK + 1)
    return posted.repartition(tasks, "key").mapInArrow(giving_back(run), "u long, v long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): each linked node with the least node it can reach. Links are (u, v), u > v."""
    links = materialize(links.distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def label_nodes(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """Adds first, the least of all rows that links lead to, to ``rows`` (each with a node)."""
    roots = connected_components(links)
    rooted = distinct.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted.select("node", "first", "root"), "rooted")
    firsts = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")), "firsts")
    named = materialize(rooted.select("node", "root").join(firsts, "root").select("node", "first"), "named")
    return rows.join(named, "node")


def least_rows(rows: DataFrame, shapes: list[str], order: list[str]) -> DataFrame:
    """One row for each node: its ``shapes`` and first, its least row by ``order``, nulls last."""
    least = F.struct(F.col(order[0]).isNull().alias("none"), *order)
    return rows.groupBy("node").agg(*[F.first(c).alias(c) for c in shapes], F.min(least).alias("first"))


def simhash_report(docs: DataFrame, shingle_words: int = 4, max_diff: int = 4) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    bound_batches(docs.sparkSession)
    prints = materialize(with_fingerprints(docs, shingle_words), "prints")
    distinct = materialize(least_rows(prints, [], ["doc_id"]), "distinct-prints")
    links = candidate_links(distinct.select("node"), max_diff)
    hexed = F.lpad(F.lower(F.hex(F.col("node"))), 16, "0")
    return label_nodes(prints, distinct, links).select("doc_id", hexed.alias("fingerprint"), F.col("first.doc_id").alias("component_id"))
