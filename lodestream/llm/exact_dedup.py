"""Exact dedup behind a Bloom filter of repeated hashes. DataFrame functions only.

Two passes. The first reads one 64-bit hash a row and counts, for each of its bit positions,
the rows that set it; positions set by two rows or more make up the filter. The second pass
tests each row: a row with an unset position has a hash that no other row has, and passes
straight through; only the others are shuffled and grouped by their SHA-256.

A filter grows with the rows, and is broadcast in blocks of bounded size. Where one block is not enough,
rows are written once by block (a part of the hashes each, without a shuffle) and blocks are worked on one
after the other, each with a filter of its own; what passes straight through is the same at every size.

Defined results: null texts count as empty and equal to empty or all-white texts; a null doc_id
loses every tie; of rows that are equal in every respect exactly one stays; an empty table gives
an empty result; further columns are carried, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.text import SPACE, text_or_empty
from lodestream.storage import materialize

BITS_PER_ROW = 16
HASHES = 3
#: A block of the filter is at most this large when broadcast.
MAX_BROADCAST_BYTES = 64 << 20


def content_sha256(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text_or_empty(text), SPACE + "+", "").cast("binary"), 256)


def filter_bits(n_rows: int) -> int:
    return 1 << max(10, (max(1, n_rows) * BITS_PER_ROW - 1).bit_length())


def _positions(key: Column, n_bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(n_bits)) for i in range(HASHES)]


def repeat_filter(keys: DataFrame, key: str, n_bits: int) -> DataFrame:
    """Pass 1: 64-bit words (word, bits) of the positions that two rows or more have set."""
    set_by = keys.select(F.explode(F.array_distinct(F.array(*_positions(F.col(key), n_bits)))).alias("pos"))
    twice = set_by.groupBy("pos").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.expr("pos div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits")
    )


def possibly_repeated(rows: DataFrame, key: str, words: DataFrame, n_bits: int, flag: str) -> DataFrame:
    """Pass 2: adds ``flag``, true where every position of the key is in the filter."""
    cols = rows.columns
    tests = []
    for i, pos in enumerate(_positions(F.col(key), n_bits)):
        w = words.select(F.col("word").alias(f"__w{i}"), F.col("bits").alias(f"__b{i}"))
        rows = rows.withColumn(f"__p{i}", pos)
        rows = rows.join(F.broadcast(w), F.expr(f"__p{i} div 64 = __w{i}"), "left")  # at most MAX_BROADCAST_BYTES
        tests.append(f"coalesce(shiftright(__b{i}, cast(__p{i} % 64 as int)) & 1L, 0L) = 1L")
    return rows.select(*cols, F.expr(" and ".join(tests)).alias(flag))


def n_blocks(n_rows: int, max_bytes: int) -> int:
    # A slot of 64 bits costs 16 bytes in the broadcast relation, and n_bits / 64 slots are its bound.
    return max(1, -(-filter_bits(n_rows) // 64 * 16 // max_bytes))


def flag_repeats(rows: DataFrame, hashes: DataFrame, key: str, max_bytes: int) -> DataFrame:
    """``rows`` with again: false where no other of the ``hashes`` (all rows' keys, written) is the same."""
    n_rows = hashes.count()
    blocks = n_blocks(n_rows, max_bytes)
    if blocks == 1:
        n_bits = filter_bits(n_rows)
        return possibly_repeated(rows, key, materialize(repeat_filter(hashes, key, n_bits), "exact-filter"), n_bits, "again")
    n_bits = filter_bits(-(-n_rows // blocks))
    of = F.pmod(F.xxhash64(F.lit(HASHES), key), F.lit(blocks))
    rows = materialize(rows.withColumn("block", of), "exact-blocks", by="block")
    hashes = materialize(hashes.select(key).withColumn("block", of), "exact-block-hashes", by="block")
    flagged = []
    for b in range(blocks):
        words = materialize(repeat_filter(hashes.where(F.col("block") == b), key, n_bits), "exact-filter")
        part = rows.where(F.col("block") == b).drop("block")
        flagged.append(materialize(possibly_repeated(part, key, words, n_bits, "again"), "exact-flagged"))
    return reduce(DataFrame.unionByName, flagged)


def dedup_report(docs: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row for each document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(
        docs.select(
            F.col("doc_id"),
            F.length(text_or_empty(F.col("text"))).alias("n"),
            content_sha256(F.col("text")).alias("sha"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "exact-hashes",
    )
    tested = flag_repeats(rows, rows.select("sha"), "sha", max_bytes)
    again = tested.where("again").drop("again")
    # The least of these structs: most code points, then smallest doc_id, nulls last.
    order = F.struct(-F.col("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    # Written out first: so the join's sides are plain shuffles, and a hot text's rows can be split.
    groups = materialize(again.groupBy("sha").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "exact-groups")
    shuffled = again.join(groups, "sha").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    straight = tested.where(~F.col("again")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return straight.unionByName(shuffled)


def exact_dedup(docs: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The documents that stay, with all their columns; whole rows shuffle only if possibly repeated."""
    keyed = docs.select(
        F.struct("*").alias("row"),
        content_sha256(F.col("text")).alias("sha"),
        F.struct(
            -F.length(text_or_empty(F.col("text"))),
            F.col("doc_id").isNull().alias("no_id"),
            F.col("doc_id").alias("id"),
        ).alias("best"),
    )
    hashes = materialize(keyed.select("sha"), "exact-hashes")
    tested = flag_repeats(keyed, hashes, "sha", max_bytes)
    # Copies collapse map-side, so a hot text sends one row from each task.
    stays = tested.where("again").groupBy("sha").agg(F.min_by("row", "best").alias("row"))
    return tested.where(~F.col("again")).select("row.*").unionByName(stays.select("row.*"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
  FROM documents
), r AS (
  SELECT doc_id, sha, count(*) OVER (PARTITION BY sha) AS c,
         first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, c AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM r
"""
