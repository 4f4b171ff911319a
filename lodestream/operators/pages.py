"""Lines that repeat at the edges of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import PAGE_NUMBER, squash, strip

EDGE = 3


def edge_key(line: Column) -> Column:
    return F.regexp_replace(squash(strip(line)), r"(?U)\d+", "#")


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, line, at_edge, key) of pages (doc_id, page, text)."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    said = F.when(strip(F.col("line")) != "", 1).otherwise(0)
    w = Window.partitionBy("doc_id", "page")
    from_top = F.sum(said).over(w.orderBy("pos"))
    from_end = F.sum(said).over(w.orderBy(F.col("pos").desc()))
    at_edge = (said == 1) & ((from_top <= EDGE) | (from_end <= EDGE))
    return lines.select("*", at_edge.alias("at_edge"), edge_key(F.col("line")).alias("key"))


def repeated_edges(lines: DataFrame) -> DataFrame:
    """(doc_id, key, pages) of edge lines on at least 60 % of a document's pages, and on two."""
    n = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    edges = lines.where("at_edge and key <> ''").select("doc_id", "page", "key").distinct()
    held = edges.groupBy("doc_id", "key").agg(F.count("*").alias("pages")).join(n, "doc_id")
    return held.where(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") * F.lit(0.6)))).select("doc_id", "key", "pages")


def strip_page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) without page numbers and repeated edge lines."""
    lines = page_lines(pages)
    again = repeated_edges(lines).select("doc_id", "key", F.lit(True).alias("again"))
    kept = lines.join(again, ["doc_id", "key"], "left").where(~F.col("line").rlike(f"(?U){PAGE_NUMBER}") & ~(F.col("at_edge") & F.coalesce("again", F.lit(False))))
    rows = kept.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    texts = rows.select("doc_id", "page", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
    return pages.select("doc_id", "page").join(texts, ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def joined_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): a document's pages in order, each after a marker of its number."""
    rows = pages.where(strip(F.col("text")) != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("rows"))
    marked = F.transform("rows", lambda r: F.concat(F.lit("[[PAGE="), r["page"].cast("string"), F.lit("]]\n"), r["text"]))
    return rows.select("doc_id", F.array_join(marked, "\n").alias("text"))
