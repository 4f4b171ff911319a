"""Chunk-store operators over documents: those with even ids are the store, those with odd ids come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import pages, store
from lodestream.operators.versions import VersionedStore
from lodestream.plans.register import Registry, sql_key, sql_strip
from lodestream.storage import new_folder, read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_STORE = "SELECT source || '/' || (doc_id % 40) AS source, lang AS tag, doc_id, CAST(0 AS INTEGER) AS chunk_id, text, sha256(text) AS doc_hash, doc_id AS ingest_seq FROM documents"


def _store(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select(
        F.concat("source", F.lit("/"), (F.col("doc_id") % 40).cast("string")).alias("source"),
        F.col("lang").alias("tag"),
        "doc_id",
        F.lit(0).alias("chunk_id"),
        "text",
        F.sha2(F.col("text").cast("binary"), 256).alias("doc_hash"),
        F.col("doc_id").alias("ingest_seq"),
    )


@register("SELECT doc_id, sha256(text) AS doc_hash FROM documents")
def hash_content(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("doc_hash"))


_FILES = "f AS (SELECT 'f' || doc_id AS source, sha256(text) AS doc_hash FROM documents), g AS (SELECT 'f' || doc_id AS source, CASE WHEN quality = 1 THEN sha256(text) ELSE 'old' END AS doc_hash FROM documents JOIN labels USING (doc_id))"


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, d, "documents")
    name, digest = F.concat(F.lit("f"), F.col("doc_id").cast("string")), F.sha2(F.col("text").cast("binary"), 256)
    known = docs.join(read_table(spark, d, "labels"), "doc_id").select(name.alias("source"), F.when(F.col("quality") == 1, digest).otherwise("old").alias("doc_hash"))
    return docs.select(name.alias("source"), digest.alias("doc_hash")), known


@register(
    f"WITH {_FILES} SELECT f.source, f.doc_hash, CASE WHEN g.doc_hash IS NULL THEN 'not_indexed' WHEN g.doc_hash = f.doc_hash THEN 'indexed' ELSE 'changed' END AS status FROM f LEFT JOIN g ON f.source = g.source"
)
def registry_status(spark: SparkSession, d: str) -> DataFrame:
    return store.file_status(*_files(spark, d))


@register(f"WITH {_FILES} SELECT source, doc_hash FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source = f.source AND g.doc_hash = f.doc_hash)")
def incremental_changed(spark: SparkSession, d: str) -> DataFrame:
    return store.changed_files(*_files(spark, d))


_OLD_NEW = f"s AS ({_STORE}), o AS (SELECT * FROM s WHERE doc_id % 2 = 0), n AS (SELECT * FROM s WHERE doc_id % 2 = 1)"
#: Sources come in under names that end in 0 or 9, so some of the store's are replaced.
_COMING = "c AS (SELECT DISTINCT regexp_replace(source, '[1357]$', '0') AS source FROM n)"
_KEPT = f"""l AS (SELECT * FROM o WHERE source NOT IN (SELECT source FROM c)),
k AS (SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY {sql_key("text")} ORDER BY ingest_seq) AS i FROM l WHERE {sql_key("text")} <> '') WHERE i = 1)"""


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _store(spark, d)
    new = s.where("doc_id % 2 = 1").withColumn("source", F.regexp_replace("source", "[1357]$", "0"))
    return s.where("doc_id % 2 = 0"), new


_UPSERTED = f"WITH {_OLD_NEW}, {_COMING}, {_KEPT} SELECT source, doc_id, ingest_seq FROM k UNION ALL SELECT regexp_replace(source, '[1357]$', '0'), doc_id, ingest_seq FROM n"


@register(_UPSERTED)
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(*_batches(spark, d)).select("source", "doc_id", "ingest_seq")


@register(_UPSERTED)
def upsert_versions(spark: SparkSession, d: str) -> DataFrame:
    """The same by buckets and manifests: two commits, of which the second writes only the buckets it touches."""
    kept = VersionedStore(spark, new_folder(spark, "chunk-store"))
    for batch in _batches(spark, d):
        kept.upsert(batch)
    return kept.read().select("source", "doc_id", "ingest_seq")


@register(
    f"""WITH {_OLD_NEW}, {_COMING}, {_KEPT} SELECT (SELECT count(*) FROM o) - (SELECT count(*) FROM l) AS removed_replaced, (SELECT count(*) FROM l) - (SELECT count(*) FROM k) AS removed_duplicates"""
)
def prune_store(spark: SparkSession, d: str) -> DataFrame:
    old, new = _batches(spark, d)
    return store.prune(old, new.select("source"))[1]


@register(f"WITH s AS ({_STORE}) SELECT source, doc_id FROM s WHERE NOT (source = 'src3/3' AND doc_id IN (3, 23, 43, 63, 83, 123, 163) AND chunk_id = 0)")
def delete_selector(spark: SparkSession, d: str) -> DataFrame:
    return store.delete(_store(spark, d), store.Selector(source="./src3/3", doc_ids=(3, 23, 43, 63, 83, 123, 163), chunk_id=0)).select("source", "doc_id")


@register(f"WITH s AS ({_STORE}) SELECT source, arg_max(doc_hash, ingest_seq) AS doc_hash FROM s GROUP BY source")
def hash_registry(spark: SparkSession, d: str) -> DataFrame:
    return store.hash_registry(_store(spark, d))


@register(f"WITH s AS ({_STORE}) SELECT regexp_replace(string_split(source, '/')[-1], '\\.[^./]+$', '') || '.json' AS path, count(*) AS n, min(text) AS first_text FROM s GROUP BY source")
def metadata_mirror(spark: SparkSession, d: str) -> DataFrame:
    mirror = store.metadata_mirror(_store(spark, d), "data")
    return mirror.select("path", F.size("records").cast("long").alias("n"), F.array_min(F.transform("records", lambda r: r["text"])).alias("first_text"))


@register(f"WITH {_OLD_NEW} SELECT source, doc_id FROM o WHERE source NOT IN (SELECT regexp_replace(source, '[1357]$', '0') FROM n) UNION ALL SELECT regexp_replace(source, '[1357]$', '0'), doc_id FROM n")
def audit_replace(spark: SparkSession, d: str) -> DataFrame:
    old, new = _batches(spark, d)
    return store.replace_audit(old, new).select("source", "doc_id")


@register("SELECT doc_id AS id, source, CAST(NULL AS VARCHAR) AS page, CAST(0 AS INTEGER) AS chunk_id, text FROM documents")
def audit_table(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark, d).withColumn("page", F.lit(None).cast("int")).withColumn("source", F.element_at(F.split("source", "/"), 1))
    return store.audit_rows(s).drop("metadata_json")


@register(f"WITH s AS ({_STORE}) SELECT source, count(*) AS chunks FROM s GROUP BY source")
def chunks_per_source(spark: SparkSession, d: str) -> DataFrame:
    return store.chunks_per_source(_store(spark, d))


@register("SELECT source, doc_id % 5 AS doc_id, arg_min(CASE WHEN lang = 'en' THEN NULL ELSE lang END, doc_id) AS tag, count(*) AS chunk_count, list(doc_id ORDER BY doc_id) AS chunk_ids FROM documents GROUP BY source, doc_id % 5")
def group_by_document(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    s = docs.select("source", (F.col("doc_id") % 5).alias("doc_id"), F.when(F.col("lang") != "en", F.col("lang")).alias("tag"), F.col("doc_id").alias("chunk_id"))
    return store.group_by_document(s)


@register(f"WITH s AS ({_STORE}) SELECT count(*) AS total_chunks, count(DISTINCT source) AS total_documents FROM s")
def index_summary(spark: SparkSession, d: str) -> DataFrame:
    return store.index_summary(_store(spark, d))


@register("SELECT DISTINCT tag FROM (SELECT lang AS tag FROM documents UNION ALL SELECT 'general')")
def distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    return store.distinct_tags(_store(spark, d))


@register("SELECT DISTINCT lang AS tag FROM documents")
def known_tags(spark: SparkSession, d: str) -> DataFrame:
    return store.known_tags(_store(spark, d))


@register("SELECT lang AS tag, list(source ORDER BY source) AS names, count(*) AS n FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def group_files(spark: SparkSession, d: str) -> DataFrame:
    files = read_table(spark, d, "documents").select(F.col("lang").alias("tag"), F.col("source").alias("name")).distinct()
    return store.group_files(files)


@register("SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build')")
def client_filter(spark: SparkSession, d: str) -> DataFrame:
    return store.client_filter(read_table(spark, d, "customer"), " Build ", "c_name", "c_mktsegment").select("c_custkey")


@register("SELECT doc_id, substr(text, 1, 1000) AS preview, length(text) > 1000 AS truncated FROM documents")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return store.preview(read_table(spark, d, "documents"), 1000).select("doc_id", "preview", "truncated")


_LINES = rf"""x AS (SELECT source AS book, doc_id AS page, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos
  FROM (SELECT source, doc_id, 'Book ' || source || ' page ' || doc_id || chr(10) || text AS t FROM documents)),
y AS (SELECT *, {sql_strip("line")} <> '' AS said, regexp_replace(regexp_replace({sql_strip("line")}, '\s+', ' ', 'g'), '\d+', '#', 'g') AS key FROM x),
z AS (SELECT *, said AND (sum(CAST(said AS INTEGER)) OVER (PARTITION BY page ORDER BY pos) <= 3 OR sum(CAST(said AS INTEGER)) OVER (PARTITION BY page ORDER BY pos DESC) <= 3) AS at_edge FROM y),
n AS (SELECT book, count(DISTINCT page) AS n_pages FROM y GROUP BY book),
e AS (SELECT book, key, count(DISTINCT page) AS pages FROM z WHERE at_edge AND key <> '' GROUP BY book, key)"""


def _book(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    head = F.concat(F.lit("Book "), "source", F.lit(" page "), F.col("doc_id").cast("string"), F.lit("\n"), "text")
    return docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), head.alias("text"))


@register(f"WITH {_LINES} SELECT book, key, pages FROM e JOIN n USING (book) WHERE pages >= greatest(2, floor(n_pages * 0.6))")
def repeated_edge_lines(spark: SparkSession, d: str) -> DataFrame:
    """Sources as books and documents as their pages, each with a running head."""
    return pages.repeated_edges(pages.page_lines(_book(spark, d))).withColumnRenamed("doc_id", "book")


@register(
    rf"""WITH {_LINES}, w AS (SELECT book, key FROM e JOIN n USING (book) WHERE pages >= greatest(2, floor(n_pages * 0.6))),
    k AS (SELECT page, line, pos FROM z LEFT JOIN w USING (book, key) WHERE NOT (at_edge AND w.key IS NOT NULL)
      AND NOT regexp_matches(line, '^\s*(?:[-–—]\s*)?(?:第\s*)?\d{{1,4}}(?:\s*页)?(?:\s*/\s*\d{{1,4}})?(?:\s*[-–—])?\s*$'))
    SELECT d.doc_id AS page, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS text FROM documents d LEFT JOIN k ON k.page = d.doc_id GROUP BY d.doc_id"""
)
def page_strip(spark: SparkSession, d: str) -> DataFrame:
    return pages.strip_page_lines(_book(spark, d)).select("page", "text")
