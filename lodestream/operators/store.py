"""The chunk store: incremental upsert, deletion, registry, summaries, snapshots."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.text import blank, mirror_path, source_key, source_key_variants
from lodestream.operators.dedup import first_per_text

CHUNK_SCHEMA = (
    "source string, tag string, doc_id long, chunk_id int, page int, doc_hash string, record_type string, "
    "split_method string, section_path string, text string, ingest_seq long"
)


def file_status(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds status: not_indexed, indexed or changed."""
    known = registry.select(F.col("source"), F.col("doc_hash").alias("known_hash"))
    status = F.when(F.col("known_hash").isNull(), "not_indexed").when(F.col("known_hash") == F.col("doc_hash"), "indexed").otherwise("changed")
    return files.join(known, "source", "left").withColumn("status", status).drop("known_hash")


def changed_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose hash the registry does not hold."""
    return files.join(registry.select("source", "doc_hash"), ["source", "doc_hash"], "left_anti")


def prune(store: DataFrame, incoming_sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, counts): rows of incoming sources go, then blank texts and later copies."""
    keyed = store.withColumn("norm", source_key(F.col("source")))
    coming = incoming_sources.select(source_key(F.col("source")).alias("norm")).where("norm <> ''").distinct()
    left = keyed.join(coming, "norm", "left_anti").drop("norm")
    stays = first_per_text(left, "ingest_seq")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(store, "a").crossJoin(n(left, "b")).crossJoin(n(stays, "c"))  # one row each
    return stays, counts.select((F.col("a") - F.col("b")).alias("removed_replaced"), (F.col("b") - F.col("c")).alias("removed_duplicates"))


def upsert(store: DataFrame | None, incoming: DataFrame, incremental: bool = True) -> DataFrame:
    """The store after a batch: sources of the batch replaced, or the batch alone if not incremental.

    A batch without chunks is an error: it would leave an index of nothing, or silently drop sources.
    """
    if incoming.isEmpty():
        raise ValueError("no chunks to add")
    if store is None or not incremental:
        return incoming
    return prune(store, incoming.select("source").distinct())[0].unionByName(incoming)


@dataclass(frozen=True)
class Selector:
    """What to delete: exactly one of ``source`` and ``metadata``; all of it or these documents."""

    source: str | None = None
    metadata: str | None = None
    delete_all: bool = False
    doc_ids: tuple[int, ...] = ()
    chunk_id: int | None = None

    def __post_init__(self) -> None:
        if bool((self.source or "").strip()) == bool((self.metadata or "").strip()):
            raise ValueError("name exactly one of source and metadata")
        if self.delete_all == bool(self.doc_ids):
            raise ValueError("either all documents or a list of them")


def sources_of(store: DataFrame, metadata: str, data_root: str = "") -> list[str]:
    """Sources whose mirror path or its name is ``metadata``; a few at most, as it names one file."""
    path = mirror_path(F.col("source"), data_root)
    name = metadata.strip()
    match = (path == name) | (F.element_at(F.split(path, "/"), -1) == name)
    found = [r.source for r in store.select("source").distinct().where(match).orderBy("source").limit(100).collect()]
    if len(found) != 1:
        raise ValueError(f"{name!r} names {'no source' if not found else f'several sources: {found}'}")
    return found


def selected(selector: Selector, sources: list[str]) -> Column:
    hit = source_key(F.col("source")).isin(sources)
    if selector.doc_ids:
        hit = hit & F.col("doc_id").isin(*selector.doc_ids)
        if selector.chunk_id is not None:
            hit = hit & (F.col("chunk_id") == selector.chunk_id)
    return F.coalesce(hit, F.lit(False))


def delete(store: DataFrame, selector: Selector, data_root: str = "") -> DataFrame:
    """The store without the selected chunks."""
    spark = store.sparkSession
    names = sources_of(store, selector.metadata, data_root) if selector.metadata else [selector.source]
    keys = [r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select(source_key(F.col("n")).alias("k")).collect()]
    return store.where(~selected(selector, keys))


def hash_registry(store: DataFrame) -> DataFrame:
    """(source, doc_hash): the last hash ingested of each source."""
    return store.where("doc_hash <> ''").groupBy("source").agg(F.max_by("doc_hash", "ingest_seq").alias("doc_hash"))


def metadata_mirror(store: DataFrame, data_root: str = "") -> DataFrame:
    """(path, records): each source's chunks in order, without source and hash."""
    kept = [c for c in store.columns if c not in ("source", "doc_hash", "text", "ingest_seq", "embedding")]
    record = F.struct(F.col("text"), F.struct(*kept).alias("metadata"))
    grouped = store.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ingest_seq", record.alias("record")))).alias("rows"))
    return grouped.select(mirror_path(F.col("source"), data_root).alias("path"), F.transform("rows", lambda r: r["record"]).alias("records"))


def audit_rows(store: DataFrame) -> DataFrame:
    """The relational view of the store: page as text, everything else as JSON."""
    kept = [c for c in store.columns if c not in ("text", "embedding", "ingest_seq")]
    return store.select(
        F.col("ingest_seq").alias("id"), "source", F.col("page").cast("string").alias("page"), "chunk_id", "text",
        F.to_json(F.struct(*kept)).alias("metadata_json"),
    )


def replace_audit(audit: DataFrame, incoming: DataFrame, incremental: bool = True, root: str = "/") -> DataFrame:
    """Audit rows after a batch: those of its sources go, under any spelling of their keys."""
    if not incremental:
        return incoming
    gone = incoming.select(F.explode(source_key_variants(F.col("source"), root)).alias("source")).distinct()
    return audit.join(gone, "source", "left_anti").unionByName(incoming)


def mirror_listing(store: DataFrame, data_root: str = "") -> DataFrame:
    """(path, records): the mirror's files and how many records each holds, by path."""
    return store.groupBy(mirror_path(F.col("source"), data_root).alias("path")).agg(F.count("*").alias("records")).orderBy("path")


def mirror_detail(store: DataFrame, path: str, data_root: str = "") -> DataFrame:
    """The chunks that one file of the mirror holds, in order."""
    return store.where(mirror_path(F.col("source"), data_root) == path).orderBy("ingest_seq")


def chunks_per_source(store: DataFrame) -> DataFrame:
    return store.groupBy("source").agg(F.count("*").alias("chunks"))


def group_by_document(store: DataFrame) -> DataFrame:
    """(source, doc_id, tag, chunk_count, chunk_ids): tag is the first that is not blank."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_id", "tag")))
    grouped = store.groupBy("source", "doc_id").agg(F.count("*").alias("chunk_count"), rows.alias("rows"))
    first = F.get(F.filter(F.transform("rows", lambda r: r["tag"]), lambda t: blank(t) != ""), F.lit(0))
    return grouped.select("source", "doc_id", first.alias("tag"), "chunk_count", F.transform("rows", lambda r: r["chunk_id"]).alias("chunk_ids"))


def index_summary(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("total_chunks"), F.countDistinct("source").alias("total_documents"))


def distinct_tags(store: DataFrame, default: str = "general") -> DataFrame:
    spark = store.sparkSession
    return store.select("tag").where("tag is not null").union(spark.createDataFrame([(default,)], "tag string")).distinct().orderBy("tag")


def known_tags(store: DataFrame) -> DataFrame:
    """Tags, longest first, so a longer one is matched before one that it contains."""
    return store.select("tag").where("tag <> ''").distinct().orderBy(F.length("tag").desc(), "tag")


def group_files(files: DataFrame) -> DataFrame:
    return files.groupBy("tag").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count("*").alias("n")).orderBy("tag")


def client_filter(df: DataFrame, query: str, *columns: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return df.where(F.contains(text, F.lit(query.strip().lower())))


def preview_parts(parts: DataFrame, key: str, order: str, label: str, max_chars: int = 120_000) -> DataFrame:
    """(key, preview, truncated): a file's parts (text, with ``label``) under headers, within a running budget.

    A part that does not fit whole is cut where the budget ends, and nothing follows it; blank lines between
    parts count. Only parts that begin within the budget are gathered, so a preview is bounded.
    """
    w = Window.partitionBy(key).orderBy(order)
    name = blank(F.col(label))
    head = F.concat(F.lit("--- part "), F.row_number().over(w), F.when(name != "", F.concat(F.lit(" (page="), name, F.lit(")"))).otherwise(""), F.lit(" ---\n"))
    blocks = parts.select(F.col(key), F.col(order).alias("nth"), F.concat(head, blank(F.col("text"))).alias("block"))
    running = Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.withColumn("end", F.sum(F.length("block") + 2).over(running) - 2)
    placed = placed.withColumns({"left": max_chars - (F.col("end") - F.length("block")), "over": F.col("end") > max_chars})
    kept = placed.where("left > 0").withColumn("block", F.expr("substring(block, 1, CAST(left AS INT))"))
    shown = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "block"))).alias("rows"))
    cut = placed.groupBy(key).agg(F.max("over").alias("truncated"))
    text = F.array_join(F.transform("rows", lambda r: r["block"]), "\n\n")
    return cut.join(shown, key).select(key, text.alias("preview"), "truncated")


def preview(docs: DataFrame, max_chars: int = 120_000) -> DataFrame:
    text = blank(F.col("text"))
    return docs.withColumns({"preview": F.substring(text, 1, max_chars), "truncated": F.length(text) > max_chars})


# Snapshots: each version is a folder of Parquet; a one-row table names the current one.


def write_snapshot(df: DataFrame, root: str) -> str:
    """Writes a new version, then points to it; readers see the old one until then."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/snapshots/{name}")
    spark = df.sparkSession
    pointer = spark.createDataFrame([(name,)], "name string").withColumn("at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/current")
    return name


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version; None if there is none yet."""
    try:
        last = spark.read.parquet(f"{root}/current").orderBy(F.col("at").desc()).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return spark.read.parquet(f"{root}/snapshots/{last.name}")


def write_mirror(store: DataFrame, root: str) -> None:
    store.drop("doc_hash", "embedding").write.mode("overwrite").partitionBy("tag").json(f"{root}/metadata")


def wipe(spark: SparkSession, root: str) -> None:
    """An empty version, with the schema of chunks."""
    write_snapshot(spark.createDataFrame([], CHUNK_SCHEMA), root)
