"""Document fingerprints by spot signatures. DataFrame functions only.

A signature is a common word (the anchor) and the content words that follow it, over other common words. Anchors
are the words of ``COMMON``, words of one letter or digit, one other word of six (told by its ends and length, so
that texts without common words have signatures too), and the beginning of the text, so every text with a word has one. A fingerprint is the set of a text's signatures, as ascending 32-bit hashes in hex. Fingerprints are
filed by the length of their sets; of two sets the smaller over the larger bounds their Jaccard likeness, so pairs whose
length partitions lie too far apart for ``LEAST`` are given 0 without a look at the sets, and equal fingerprints 1.

The document that comes next is found on digests: (key, doc_id, length) is sorted by ranges and numbered, and each
key learns the next one's. Whole texts are shuffled once, by key; what goes to the document before is the
beginning that it asks for, and the next one's set.

Defined results: null texts count as empty; a text without words has the empty fingerprint, of likeness 1 to
another empty one and 0 to any other; rows of equal doc_id and text are one document and get the same result, each in a
row of its own; null doc_ids come first; of one doc_id the smaller SHA-256 of doc_id and text comes first; the only
document is its own next one; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.scan import let
from lodestream.llm.order import numbered, sorted_runs
from lodestream.llm.text import text_or_empty
from lodestream.storage import materialize, scratch

#: Common words of English, German, French and Spanish.
COMMON = tuple(
    """
    the of and to in is that it for was on are as with his they at be this have from or had by but not what all were we when your can there an which their if will
    der die das und ist nicht ein eine den dem mit zu von sich auf im für des auch es an als wie
    le la les un une et est que qui dans en du pour au par sur ce il elle pas plus ne
    el los las una del por con para se su lo al como más pero sus fue
    """.split()
)
#: One word of so many is an anchor, though not common.
ONE_OF = 6
#: Content words of a chain.
CHAIN = 2
#: A likeness that cannot reach this is given as 0.
LEAST = 0.05
#: Sets of one length partition differ in length by this factor at most.
PARTITION_FACTOR = 1.25
_HASH_DIGITS = 8


def words(text: Column) -> Column:
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def is_anchor(word: Column) -> Column:
    told = F.ascii(word) + F.ascii(F.substring(word, -1, 1)) + F.length(word)
    return (F.length(word) == 1) | word.isin(*COMMON) | (told % ONE_OF == 0)


def signatures(text: Column) -> Column:
    """Array of the signatures as texts, in order, repeats included."""

    def chains(tagged: Column) -> Column:
        anchors = F.filter(tagged, lambda x: x["anchor"])
        # Before the j-th anchor, at i, there are i - j content words.
        after = F.transform(anchors, lambda x, j: F.struct(x["w"].alias("w"), (x["i"] - j).alias("k")))
        every = F.concat(F.array(F.struct(F.lit("^").alias("w"), F.lit(0).alias("k"))), after)
        content = F.transform(F.filter(tagged, lambda x: ~x["anchor"]), lambda x: x["w"])
        joined = let(content, lambda c: F.transform(every, lambda x: F.concat_ws(" ", x["w"], *[F.get(c, x["k"] + i) for i in range(CHAIN)])))
        return F.when(F.size(tagged) == 0, F.array().cast("array<string>")).otherwise(joined)

    tagged = F.transform(words(text), lambda w, i: F.struct(w.alias("w"), i.alias("i"), is_anchor(w).alias("anchor")))
    return let(tagged, chains)


def signature_set(text: Column) -> Column:
    """Ascending distinct 32-bit hashes of the signatures, as long as they are signed integers."""

    def hashed(s: Column) -> Column:
        return (F.conv(F.substring(F.md5(s.cast("binary")), 1, _HASH_DIGITS), 16, 10).cast("long") - F.lit(1 << 31)).cast("int")

    return F.array_sort(F.array_distinct(F.transform(signatures(text), hashed)))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + F.lit(1 << 31)), _HASH_DIGITS, "0"))), "")


def length_partition(sigs: Column) -> Column:
    """Number of the partition by set length; empty sets have none."""
    return F.when(F.size(sigs) > 0, F.floor(F.ln(F.size(sigs).cast("double")) / math.log(PARTITION_FACTOR)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets, by their lengths alone where these settle it."""
    far = math.ceil(math.log(1 / LEAST) / math.log(PARTITION_FACTOR)) + 1  # partitions: the lengths' ratio is below LEAST
    both = let(F.size(F.array_intersect(a, b)).cast("double"), lambda n: n / (F.size(a) + F.size(b) - n))
    apart = F.abs(length_partition(a) - length_partition(b))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0) | (apart >= far), 0.0).otherwise(both)


def with_next(texts: DataFrame) -> DataFrame:
    """``texts`` (key, doc_id, text) as (key, doc_id, next, take): each distinct key, the one after it by
    (doc_id, key), and a quarter of the text's code points."""
    keys = materialize(texts.select("key", "doc_id", F.length("text").alias("n"), F.lit("").alias("all")).distinct(), "spot-keys")
    runs = sorted_runs(keys, F.col("all"), F.col("doc_id").asc_nulls_first(), F.col("key"), label="spot-runs")
    places = materialize(numbered(runs, "all"), "spot-places")
    after = places.select(F.pmod(F.col("pos") - 1, F.col("size")).alias("pos"), F.col("key").alias("next"))
    return places.join(after, "pos").select("key", "doc_id", "next", F.expr("n div 4").cast("int").alias("take"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each of ``docs``.

    The edited text has its last quarter replaced by the beginning of the next document.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    texts = texts.withColumn("key", F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text").cast("binary"), 256)))
    with scratch(spark):
        order = materialize(with_next(texts), "spot-order", keep=True)
    asked = order.select(F.col("key").alias("asker"), F.col("doc_id").alias("asker_id"), F.col("next").alias("key"), "take")
    # The same two columns on both sides below, by the same key: shuffled once.
    signed = texts.select("key", F.struct("text", signature_set(F.col("text")).alias("sigs")).alias("doc"))
    # What the document before asks for; rows that are equal send it once.
    sent = signed.join(asked, "key").select(
        F.col("asker").alias("key"), F.col("asker_id").alias("doc_id"), "take", F.substring("doc.text", F.lit(1), F.col("take")).alias("start"), F.col("doc.sigs").alias("next_sigs")
    )
    sent = sent.groupBy("key").agg(*[F.first(c).alias(c) for c in ("doc_id", "take", "start", "next_sigs")])
    rows = signed.join(sent, "key").withColumn("n_chars", F.length("doc.text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("doc.text", F.lit(1), (F.col("n_chars") - F.col("take")).cast("int")), "start"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("doc.sigs").alias("sigs"), signature_set(F.col("edited")).alias("edited_sigs"), "next_sigs")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        length_partition(F.col("sigs")).alias("length_partition"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for ``fingerprint_report``."""
    common = ", ".join(f"'{w}'" for w in COMMON)
    is_anchor = f"(length({{0}}) = 1 OR {{0}} IN ({common}) OR (unicode({{0}}) + unicode(right({{0}}, 1)) + length({{0}})) % {ONE_OF} = 0)"
    far = math.ceil(math.log(1 / LEAST) / math.log(PARTITION_FACTOR)) + 1
    near = f"CASE WHEN {{0}}.sigs = {{1}}.sigs THEN 1.0 WHEN len({{0}}.sigs) = 0 OR len({{1}}.sigs) = 0 OR abs({{0}}.part - {{1}}.part) >= {far} THEN 0.0 ELSE CAST(len(list_intersect({{0}}.sigs, {{1}}.sigs)) AS DOUBLE) / (len({{0}}.sigs) + len({{1}}.sigs) - len(list_intersect({{0}}.sigs, {{1}}.sigs))) END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
k AS (SELECT DISTINCT doc_id, t, key FROM d),
o AS (SELECT key, t, length(t) // 4 AS take, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(key) OVER w, first_value(key) OVER w) AS nkey
      FROM k WINDOW w AS (ORDER BY doc_id NULLS FIRST, key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT key, nkey, t, substr(t, 1, length(t) - take) || substr(nt, 1, take) AS edited FROM o),
u AS (SELECT key, 0 AS kind, t AS x FROM e UNION ALL SELECT key, 1, edited FROM e),
w AS (SELECT key, kind, list_filter(string_split(regexp_replace(translate(x, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM u),
a AS (SELECT key, kind, ws, list_filter(ws, lambda w: NOT {is_anchor.format("w")}) AS content,
      list_filter(list_transform(ws, lambda w, i: {{'w': w, 'i': i}}), lambda x: {is_anchor.format("x.w")}) AS anchors FROM w),
c AS (SELECT key, kind, ws, content, list_concat([{{'w': '^', 'k': CAST(0 AS BIGINT)}}], list_transform(anchors, lambda x, j: {{'w': x.w, 'k': CAST(x.i - j AS BIGINT)}})) AS every FROM a),
g AS (SELECT key, kind, CASE WHEN len(ws) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(every,
      lambda x: CAST('0x' || substr(md5(array_to_string(list_concat([x.w], content[x.k + 1:x.k + {CHAIN}]), ' ')), 1, {_HASH_DIGITS}) AS BIGINT)))) END AS sigs FROM c),
s AS (SELECT key, kind, sigs, CASE WHEN len(sigs) > 0 THEN CAST(floor(ln(len(sigs)) / {math.log(PARTITION_FACTOR)!r}) AS BIGINT) END AS part,
      array_to_string(list_transform(sigs, lambda v: lower(lpad(to_hex(v), {_HASH_DIGITS}, '0'))), '') AS fp FROM g)
SELECT d.doc_id, length(d.t) AS n_chars, sha256(e.edited) AS edited_sha256, own.fp AS fingerprint, ed.fp AS edited_fingerprint,
       {near.format("own", "ed")} AS near_edited, {near.format("own", "nx")} AS near_next, own.part AS length_partition
FROM d JOIN e ON e.key = d.key JOIN s own ON own.key = d.key AND own.kind = 0 JOIN s ed ON ed.key = d.key AND ed.kind = 1
JOIN s nx ON nx.key = e.nkey AND nx.kind = 0
"""
