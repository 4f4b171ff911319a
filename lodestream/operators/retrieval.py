"""Exact top-k retrieval and what follows it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.overlap import repeats_known
from lodestream.functions.text import blank
from lodestream.operators.vectors import CellIndex, build_index, scan_top_k

OVERFETCH = 8
TOP_K = 8
#: A query set is sent to every task up to this many rows.
MAX_QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero vectors count as of length one."""
    norm = lambda v: F.when(dot(v, v) == 0, 1.0).otherwise(F.sqrt(dot(v, v)))
    return dot(a, b) / (norm(a) * norm(b))


def relevance(cos: Column) -> Column:
    """Cosine of unit vectors as the relevance of a squared Euclidean distance: 1 - d / sqrt 2."""
    return F.lit(1.0) - F.lit(math.sqrt(2.0)) * (F.lit(1.0) - cos)


def query_prefix(query: Column, instruction: str) -> Column:
    return F.when((blank(query) == "") | query.startswith(instruction), query).otherwise(F.concat(F.lit(instruction), query))


def _ranked(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    """Ranks below k + 1; the limit is pushed below the shuffle, so each task sends k rows a query."""
    w = Window.partitionBy("query_id").orderBy(F.col("vector_score").desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, id_col: str = "vec_id") -> DataFrame:
    """Each query (query_id, query_vector) against all chunks (``id_col``, embedding, ...): exact.

    Up to ``MAX_QUERIES`` go to every task, which scans its chunks once; more meet the chunks block by block.
    """
    if queries.count() > MAX_QUERIES:
        return search(build_index(chunks, id_col), queries, k)
    return _ranked(scan_top_k(queries, chunks, k, id_col), k, id_col)


def search(index: CellIndex, queries: DataFrame, k: int = TOP_K, probes: int | None = None) -> DataFrame:
    """``top_k`` over an index; with ``probes`` over the nearest cells only, which may miss some."""
    return _ranked(index.search(queries, k, probes), k, index.id_col)


def top_k_tagged(
    queries: DataFrame, chunks: DataFrame, tags: list[str], k: int = TOP_K, mode: str = "post", id_col: str = "vec_id", tag_col: str = "tag"
) -> DataFrame:
    """Top k among the tags: ``post`` ranks 8 k first and filters then, so fewer than k may be left;
    ``pre`` filters first."""
    low = [t.lower() for t in tags]
    if mode == "pre":
        return top_k(queries, chunks.where(F.lower(tag_col).isin(low)), k, id_col)
    hits = top_k(queries, chunks, k * OVERFETCH if tags else k, id_col)
    if tags:
        hits = hits.where(F.lower(tag_col).isin(low))
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(hits: DataFrame, score: Column | None, n: int) -> DataFrame:
    """The best n by ``score``, earlier rank first among equals; without a score the first n as they are."""
    if score is None:
        return hits.where(F.col("rank") <= n).withColumn("rerank_score", F.lit(None).cast("double"))
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return hits.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _is_above(threshold: float, score: str) -> Column:
    return (F.coalesce(F.col(score), F.lit(0.0)) >= threshold) & (blank(F.col("text")) != "")


def above(hits: DataFrame, threshold: float, score: str = "vector_score") -> DataFrame:
    return hits.where(_is_above(threshold, score))


def build_context(hits: DataFrame, threshold: float) -> DataFrame:
    """(query_id, context): texts at or above the threshold in rank order, a blank line between.

    The hits are read once: a query with none above the threshold is a group with nothing in it.
    """
    row = F.when(_is_above(threshold, "vector_score"), F.struct("rank", "text"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("query_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("context"))


def drop_known_scripts(hits: DataFrame, asks: Column, utterances: Column) -> DataFrame:
    """Hits that neither ask again what was asked nor repeat what was said."""
    return hits.where(~repeats_known(F.col("text"), asks, utterances))


def exact_quantiles(rows: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, quantile): the interpolated quantile ``q`` of each group's values, nulls left out.

    Found by counting: equal values are added up before they are shuffled, and a running sum over a group's distinct
    values tells which hold the two ranks. No task holds a group's rows; of values rounded to six places between
    0 and 2 a group has two million distinct ones at most, however many rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    upto = F.sum("n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"upto": upto, "at": (F.sum("n").over(whole) - 1) * F.lit(q)})
    ranks = placed.groupBy(group).agg(
        F.min(F.when(F.col("upto") > F.floor("at"), F.col(value))).alias("low"),
        F.min(F.when(F.col("upto") > F.ceil("at"), F.col(value))).alias("high"),
        F.max("at").alias("at"),
    )
    return ranks.select(group, (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("quantile"))


def semantic_breaks(sentences: DataFrame, percentile: float = 88.0) -> DataFrame:
    """For (doc_id, sent_id, embedding): distance to the next sentence and whether the text breaks after it."""
    w = Window.partitionBy("doc_id").orderBy("sent_id")
    after = sentences.withColumn("next", F.lead("embedding").over(w)).where("next is not null")
    apart = after.select("doc_id", "sent_id", F.round(1.0 - cosine(F.col("embedding"), F.col("next")), 6).alias("distance"))
    limit = exact_quantiles(apart, "doc_id", "distance", percentile / 100).select("doc_id", F.round("quantile", 6).alias("threshold"))
    return apart.join(limit, "doc_id").select("doc_id", "sent_id", "distance", (F.col("distance") >= F.col("threshold")).alias("breaks"))
