"""Quality rules, with cross-document line frequency.

Each document gets counts that depend on its text alone and fails outright if it has few words or
repeats itself. The method then looks across documents: lines are normalised (words joined by one
space, A-Z lowered) and hashed, the distinct documents of a host that hold a line are counted, and
lines above both limits are boilerplate. A document of which more than half the words lie in such
lines is depleted and rejected; from others ``strip_lines`` removes them.

A document sends one narrow row for each of its distinct lines, counted map-side before the shuffle.

Defined results: null texts have no words and fail; a null source is a host of its own; every row
counts as a document, equal rows and ids too; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.buffers import SLICE_BYTES, SPACE_BYTE, giving_back, number_words, slices, text_bytes
from lodestream.llm.text import text_or_empty
from lodestream.storage import bound_batches, materialize

MIN_WORDS = 50
#: A line is boilerplate in a host if more documents than LINE_DOCS hold it, and either more than this
#: percentage of the host's or more than LINE_MOST, so a large host is allowed no more than that.
LINE_DOCS = 10
LINE_PERCENT = 1
LINE_MOST = 1000
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def normal_line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(line.lower().split())) - (1 << 63)


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True flags in each document's bytes."""
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, offsets))


def _analyse(buf: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], list[dict[int, int]]]:
    """Counts, and {line hash: words in it}, of each document; offsets are its bounds in ``buf``."""
    n = len(offsets) - 1
    space = SPACE_BYTE[buf]
    begin, doc, word = number_words(buf, offsets)
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": _per_doc(~space & ((buf & 0xC0) != 0x80), offsets),
        "n_symbols": _per_doc(_SYMBOL[buf], offsets),
    }
    repeat = np.zeros(len(begin), dtype=bool)
    if len(begin) >= 3:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        many = int(word.max()) + 1
        # Pairs are numbered before triples, and triples before they meet documents, so no product overflows.
        _, pair = np.unique(word[at] * many + word[at + 1], return_inverse=True)
        _, window = np.unique(pair * many + word[at + 2], return_inverse=True)
        _, same, count = np.unique(window * n + doc[at], return_inverse=True, return_counts=True)
        again = at[count[same] > 1]
        for k in range(3):
            repeat[again + k] = True
    out["n_repeat_words"] = np.bincount(doc[repeat], minlength=n)
    # Lines with a word: a document's or a line's end starts another.
    breaks = np.flatnonzero(buf == 0x0A)
    nth = np.searchsorted(breaks, begin)
    _, first, held = np.unique(nth + doc, return_index=True, return_counts=True)
    line_doc = doc[first]
    left = np.concatenate([[0], breaks + 1])[nth[first]]
    right = np.append(breaks, len(buf))[nth[first]]
    left, right = np.maximum(left, offsets[line_doc]), np.minimum(right, offsets[line_doc + 1])
    raw, seen, dup = buf.tobytes(), set(), np.zeros(n, dtype=np.int64)
    lines: list[dict[int, int]] = [{} for _ in range(n)]
    for d, a, b, w in zip(line_doc.tolist(), left.tolist(), right.tolist(), held.tolist(), strict=True):
        line = raw[a:b]
        if (d, line) in seen:
            dup[d] += 1
        seen.add((d, line))
        h = normal_line_hash(line)
        lines[d][h] = lines[d].get(h, 0) + w
    out["n_dup_lines"] = dup
    return out, lines


def line_statistics(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, text_hash, the counts of STATS and lines (h, w) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, SLICE_BYTES):
                cut = np.ascontiguousarray(buf[offsets[a] : offsets[b]])
                stats, lines = _analyse(cut, offsets[a : b + 1] - offsets[a])
                ends = np.cumsum([0, *map(len, lines)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays(
                    [pa.array([h for d in lines for h in d], pa.int64()), pa.array([w for d in lines for w in d.values()], pa.int64())],
                    ["h", "w"],
                )
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("uid", "doc_id", "source", "text_hash")]
                    + [pa.array(stats[k].astype(np.int64)) for k in STATS]
                    + [pa.ListArray.from_arrays(pa.array(ends), pairs)],
                    ["uid", "doc_id", "source", "text_hash", *STATS, "lines"],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(text_or_empty(F.col("text"))).alias("text_hash"),
        text_or_empty(F.col("text")).alias("text"),
    )
    counts = ", ".join(f"{k} long" for k in STATS)
    return rows.mapInArrow(giving_back(run), f"uid long, doc_id long, source string, text_hash long, {counts}, lines array<struct<h: long, w: long>>")


def frequent_lines(stats: DataFrame) -> DataFrame:
    """(host, h) of the lines that more of a host's documents hold than the limits allow."""
    hosts = stats.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("docs"))
    lines = stats.select(F.col("source").alias("host"), F.explode("lines.h").alias("h"))
    held = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > LINE_DOCS)
    often = (F.col("n") * 100 > F.col("docs") * LINE_PERCENT) | (F.col("n") > LINE_MOST)
    return held.join(hosts, F.col("host").eqNullSafe(F.col("name"))).where(often).select("host", "h")


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statistics with n_removed, base_failed and kept, and the lines (uid, h) that are boilerplate."""
    bound_batches(docs.sparkSession)
    stats = materialize(line_statistics(docs), "line-statistics")
    frequent = materialize(frequent_lines(stats), "frequent-lines")
    lines = stats.select("uid", "source", F.explode("lines").alias("line")).select("uid", "source", "line.h", "line.w")
    often = lines.join(frequent.withColumnRenamed("h", "often"), (F.col("h") == F.col("often")) & F.col("source").eqNullSafe(F.col("host")))
    removed = often.groupBy("uid").agg(F.sum("w").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = stats.drop("lines").join(removed, "uid", "left").withColumn("n_removed", F.coalesce("removed", F.lit(0)))
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (2 * F.col("n_removed") <= F.col("n_words")))
    return judged, often.select("uid", "h")


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept: one row for each document."""
    return _judged(docs)[0].select("doc_id", *STATS, "n_removed", "base_failed", "kept")


def strip_lines(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their boilerplate lines; columns of ``docs``, n_chars follows the text.

    What is removed depends on host and text alone, so rows are told apart by these. A document's list of
    removed lines is no longer than its text.
    """
    judged, often = _judged(docs)
    gone = often.groupBy("uid").agg(F.collect_set("h").alias("gone"))
    kept = judged.where("kept").join(gone, "uid", "left").groupBy("source", "text_hash").agg(F.first("gone").alias("gone"))
    kept = materialize(kept.select(F.col("source").alias("host"), "text_hash", "gone"), "kept-texts")

    def without(text: str, lines: frozenset[int]) -> str:
        return "\n".join(x for x in text.split("\n") if normal_line_hash(x.encode()) not in lines) if lines else text

    @F.arrow_udf("string")
    def cut(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, gone in texts:
            pairs = zip(text.to_pylist(), gone.to_pylist(), strict=True)
            yield pa.array([without(t, frozenset(g or ())) for t, g in pairs], pa.string())

    rows = docs.select(
        F.struct("*").alias("row"), F.col("source").cast("string").alias("own"), F.xxhash64(text_or_empty(F.col("text"))).alias("own_hash")
    )
    rows = rows.join(kept, F.col("own").eqNullSafe(F.col("host")) & (F.col("own_hash") == F.col("text_hash")))
    rows = rows.withColumn("cut", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(cut(text_or_empty(F.col("row.text")), "gone")))
    row = F.col("row").withField("text", F.col("cut"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("cut").cast(docs.schema["n_chars"].dataType))
    return rows.select(row.alias("row")).select("row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT uid, unnest(ws) AS word, unnest(range(len(ws))) AS i
      FROM (SELECT uid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT uid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win
      FROM w WINDOW o AS (PARTITION BY uid ORDER BY i)),
again AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, win) AS c FROM g WHERE win IS NOT NULL) WHERE c > 1),
rep AS (SELECT uid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY uid),
ln AS (SELECT uid, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
              array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+'), ' ') AS norm
       FROM (SELECT uid, source, unnest(string_split(t, chr(10))) AS line FROM d)),
dl AS (SELECT uid, count(*) - count(DISTINCT line) AS n FROM ln WHERE nw > 0 GROUP BY uid),
host AS (SELECT source AS name, count(*) AS docs FROM d GROUP BY source),
f AS (SELECT source AS host, norm AS often FROM (SELECT source, norm, count(DISTINCT uid) AS n FROM ln WHERE nw > 0 GROUP BY ALL)
      JOIN host ON source IS NOT DISTINCT FROM name WHERE n > 10 AND (n * 100 > docs OR n > 1000)),
r AS (SELECT uid, sum(nw) AS n FROM ln JOIN f ON norm = often AND source IS NOT DISTINCT FROM host GROUP BY uid),
s AS (SELECT uid, doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words) AND 2 * coalesce(r.n, 0) <= n_words AS kept
FROM s LEFT JOIN rep USING (uid) LEFT JOIN dl USING (uid) LEFT JOIN r USING (uid)
"""
