"""Which texts of a visitor repeat an earlier or a known one: an anti join on coverage, in blocks.

Each text has a few sets of character pairs (its clause cores); a known text covers another if, of any two of their
sets, the smaller one is held by the other up to a limit. Texts are told apart once, whatever the copies. A visitor's
texts are dealt by hash over blocks, known ones too; each known block meets the visitor's other blocks under a
key of its own, so one visitor with a large share of all texts is spread over tasks. In a task the sizes of all
common parts of two blocks are one matrix product, a slice of pairs of characters at a time.

Defined results: null texts count as empty, texts without pairs neither cover nor are covered; a null visitor is a
visitor; empty tables cover nothing; texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestream.functions.overlap import core_sets
from lodestream.storage import bound_batches

#: Texts in a block; sets and character pairs in a slice of a product.
BLOCK, SETS, PAIRS = 512, 512, 4096


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _members(codes: np.ndarray, rows: np.ndarray, n: int, low: int, width: int) -> np.ndarray:
    """A row for each of ``n`` sets, a column for each code from ``low``: 1 where the set holds it."""
    here = (codes >= low) & (codes < low + width)
    out = np.zeros((n, width), dtype=np.float32)
    out[rows[here], codes[here] - low] = 1.0
    return out


def first_covering(hits: pa.Array, known: pa.Array, limit: float) -> np.ndarray:
    """For each of the sets ``hits`` (lists) the place of the first of the sets ``known`` that covers it, or -1."""
    sizes = [np.asarray(pc.list_value_length(x), dtype=np.int64) for x in (hits, known)]
    coded = pa.concat_arrays([hits.flatten(), known.flatten()]).dictionary_encode()
    codes, kinds = np.asarray(coded.indices), len(coded.dictionary)
    ends = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
    both = codes[: ends[0][-1]], codes[ends[0][-1] :]

    def part(side: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        return both[side][ends[side][low] : ends[side][high]], np.repeat(np.arange(high - low), sizes[side][low:high])

    found = np.full(len(hits), -1, dtype=np.int64)
    for a in range(0, len(hits), SETS):
        z = min(a + SETS, len(hits))
        left = part(0, a, z)
        for b in range(0, len(known), SETS):
            if (found[a:z] >= 0).all():
                break
            y = min(b + SETS, len(known))
            right = part(1, b, y)
            common = np.zeros((z - a, y - b), dtype=np.float32)
            for low in range(0, kinds, PAIRS):
                width = min(PAIRS, kinds - low)
                common += _members(*left, z - a, low, width) @ _members(*right, y - b, low, width).T
            covers = common.astype(np.float64) / np.minimum.outer(sizes[0][a:z], sizes[1][b:y]) >= limit
            new = covers.any(axis=1) & (found[a:z] < 0)
            found[a:z][new] = b + covers[new].argmax(axis=1)
    return found


def first_covers(texts: DataFrame, known: DataFrame, limit: float) -> DataFrame:
    """(of, covered, at): for texts (visitor, text) by digest, the least ``at`` of the visitor's known texts
    (visitor, text, at) that covers them; texts that none covers are left out."""
    bound_batches(texts.sparkSession)
    texts = texts.select("visitor", F.coalesce("text", F.lit("")).alias("text")).distinct()
    known = known.select(F.col("visitor").alias("of"), F.coalesce("text", F.lit("")).alias("text"), "at").groupBy("of", "text").agg(F.min("at").alias("at"))

    def dealt(rows: DataFrame, key: str, payload: str) -> DataFrame:
        """A row for each set of pairs of each text, with a block for the text and the visitor's number of blocks."""
        counts = rows.groupBy(F.col(key).alias("whose")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        of_all = rows.join(counts, F.col(key).eqNullSafe(F.col("whose")))
        block = F.pmod(F.xxhash64("text"), F.col("blocks"))
        sets = of_all.select(key, block.alias("block"), payload, F.explode(F.filter(core_sets(F.col("text")), lambda s: F.size(s) > 0)).alias("pairs"))
        return sets.groupBy(key, "block").agg(F.sort_array(F.collect_list(F.struct(payload, "pairs"))).alias("sets"))

    met = dealt(known, "of", "at").withColumnRenamed("sets", "known_sets")
    meets = F.col("visitor").eqNullSafe(F.col("of"))
    ours = dealt(texts.withColumn("covered", digest(F.col("text"))), "visitor", "covered").withColumnRenamed("block", "own")
    # The known blocks that a visitor's blocks have to meet are told by their number, so no known text is read for that.
    blocks = known.groupBy("of").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    pairs = ours.join(blocks, meets).select("visitor", "sets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.join(met, meets & (F.col("other") == F.col("block"))).select("of", "sets", "known_sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, sets = batch.column("sets")[i].values.flatten()
                at, known_sets = batch.column("known_sets")[i].values.flatten()
                found = first_covering(sets, known_sets, limit)
                rows = np.flatnonzero(found >= 0)
                of = batch.column("of").take(pa.array(np.full(len(rows), i)))
                yield pa.RecordBatch.from_arrays([of, names.take(pa.array(rows)), at.take(pa.array(found[rows]))], ["of", "covered", "at"])

    schema = StructType([met.schema["of"], *StructType.fromDDL("covered string").fields, known.schema["at"]])
    return pairs.mapInArrow(run, schema).groupBy("of", "covered").agg(F.min("at").alias("at"))


def drop_covered(hits: DataFrame, known: DataFrame, limit: float, before: str | None = None) -> DataFrame:
    """Hits (visitor, text, ...) that no known text (visitor, text, and at if ``before`` is given) of the visitor covers.

    With ``before``, a column of the hits, only known texts whose ``at`` is less than that count.
    """
    known = known if before else known.withColumn("at", F.lit(0))
    covers = first_covers(hits, known, limit)
    same = F.col("visitor").eqNullSafe(F.col("__of")) & (F.col("__covered") == digest(F.col("text")))
    if before:
        same &= F.col("__at") < F.col(before)
    return hits.join(covers.select(F.col("of").alias("__of"), F.col("covered").alias("__covered"), F.col("at").alias("__at")), same, "left_anti")
