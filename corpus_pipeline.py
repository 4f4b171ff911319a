"""From raw documents to token ids, in stages; each reads what the one before it wrote.

Counted as part of lodestream.llm. Each stage works on all rows it gets; all but the last return the
columns of ``documents``. No single SQL statement expresses the classifier, the fingerprints or the
codec, so there is none; tests/llm hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm.exact_dedup import exact_dedup
from lodestream.llm.mixing import mix_sources
from lodestream.llm.near_copies import drop_near_copies
from lodestream.llm.quality_classifier import keep_quality
from lodestream.llm.sentencepiece import encode_documents
from lodestream.storage import materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target shares."""
    return mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return encode_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources", mix),
    ("SentencePiece encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage-" + name.lower().replace(" ", "-"))
    return docs


ORACLE_SQL = None
