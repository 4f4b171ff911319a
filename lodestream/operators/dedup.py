"""First row of each text, without a window over the text: copies collapse before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.text import blank, dedup_key, strip


def first_per_text(df: DataFrame, *order: str) -> DataFrame:
    """For each text that is not blank, white space and case aside, the row that comes first by ``order``."""
    # Grouped by a digest, so long texts are neither sorted nor shuffled as keys; blank texts are told by their ends,
    # so the key is made once a row.
    rows = df.where(strip(blank(F.col("text"))) != "").select(F.struct("*").alias("row"), F.sha2(dedup_key(F.col("text")).cast("binary"), 256).alias("key"))
    return rows.groupBy("key").agg(F.min_by("row", F.struct(*[F.col(f"row.{c}") for c in order])).alias("row")).select("row.*")


def dedup_documents(records: DataFrame, order: str = "doc_id") -> DataFrame:
    """The first record of each text; white space and case make no difference; blank ones go."""
    return first_per_text(records, order)


def number_chunks(candidates: DataFrame, min_chars: int = 15, document: str = "doc_id") -> DataFrame:
    """Chunks of a batch from candidates (doc_id, pos, body, text, atomic), of documents told apart by ``document``.

    Short bodies go (records that stay whole are exempt), of equal texts across the batch the first
    stays, and each document's chunks are numbered from 0 in order.
    """
    whole = F.col("atomic") if "atomic" in candidates.columns else F.lit(False)
    long = candidates.where(whole | (F.length(strip(F.col("body"))) >= min_chars))
    kept = first_per_text(long, *dict.fromkeys(("doc_id", document, "pos")))
    return kept.withColumn("chunk_id", F.row_number().over(Window.partitionBy(document).orderBy("pos")) - 1)


def blank_repeated_slots(hits: DataFrame, *slot: str) -> DataFrame:
    """Within a query a slot that comes up again keeps its rank but loses its text."""
    w = Window.partitionBy("query_id", *slot).orderBy("rank")
    return hits.withColumn("n", F.row_number().over(w)).withColumn("text", F.when(F.col("n") == 1, F.col("text")).otherwise("")).drop("n")
