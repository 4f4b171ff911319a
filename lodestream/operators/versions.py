"""The chunk store on disk: buckets of files, a manifest for each version, commits that only one writer can win.

Chunks are dealt to buckets by a hash of their source's key, so a source lies in one bucket. Data files are never
changed: a batch writes new files for the buckets it touches, and a manifest that names the files of every bucket,
new ones and old ones. A manifest is a file named by its version and is created only where none of that name is, so
of two writers that began from the same version one fails, with nothing of its own to be seen; readers see the
last version until the next is there, and may name an earlier one.

Which buckets a batch touches: those of its sources, and those that hold a later copy of a text that the store has
already. Copies are found on digests: a scan of two narrow columns, and a shuffle of the digests; texts are read
and written of the touched buckets only.

Defined results: blank texts are not stored; a null source is a source; a batch without chunks is an error; a
store that nothing was committed to has no version and reads as None.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestream.functions.text import blank, dedup_key, source_key
from lodestream.operators.store import Selector, selected, sources_of

BUCKETS = 64
_OWN = [StructField("bucket", IntegerType()), StructField("digest", StringType())]


class CommitConflict(Exception):
    """Another writer has committed the version that this one was to be."""


@dataclass(frozen=True)
class Manifest:
    """``files``: the folder of each bucket that has rows; ``schema``: that of the chunks, as JSON."""

    version: int
    n_buckets: int
    schema: str
    files: dict[int, str]


def _key(source: Column) -> Column:
    return source_key(blank(source))


class VersionedStore:
    """Chunks (source, doc_id, text, ingest_seq, ...) below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.n_buckets = spark, root.rstrip("/"), n_buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests

    def _log(self, version: int) -> str:
        return f"{self.root}/log/{version:020d}.json"

    def versions(self) -> list[int]:
        log = self._path(f"{self.root}/log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        rows = self.spark.read.text(self._log(version), wholetext=True).first()
        data = json.loads(rows.value)
        return Manifest(data["version"], data["n_buckets"], json.dumps(data["schema"]), {int(b): f for b, f in data["files"].items()})

    def _create(self, name: str, text: str) -> None:
        """Writes a file that must not be there yet: to the side first, then under its name, which one writer gets."""
        aside = f"{self.root}/log/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        uri = self._fs.makeQualified(self._path(name)).toUri()
        try:
            if uri.getScheme() == "file":
                # Hadoop's rename looks first and renames then; a link is one step.
                os.link(self._fs.makeQualified(self._path(aside)).toUri().getPath(), uri.getPath())
            else:
                context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(self._path(aside), self._path(name), none)
        except FileExistsError as e:
            raise CommitConflict(name) from e
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(name) from e
            raise
        finally:
            self._fs.delete(self._path(aside), False)

    def _commit(self, base: Manifest | None, schema: StructType, files: dict[int, str]) -> Manifest:
        new = Manifest((base.version if base else -1) + 1, base.n_buckets if base else self.n_buckets, schema.json(), files)
        self._fs.mkdirs(self._path(f"{self.root}/log"))
        self._create(self._log(new.version), json.dumps({"version": new.version, "n_buckets": new.n_buckets, "schema": json.loads(new.schema), "files": files}))
        return new

    # Data

    def _read(self, m: Manifest, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType([*StructType.fromJson(json.loads(m.schema)).fields, *_OWN])
        paths = [f"{self.root}/data/{f}" for b, f in sorted(m.files.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The chunks of a version, the last one by default; None if there is none."""
        m = self.manifest(version)
        return None if m is None else self._read(m).drop("bucket", "digest")

    def _placed(self, chunks: DataFrame, n_buckets: int) -> DataFrame:
        own = chunks.withColumns(
            {
                "bucket": F.pmod(F.xxhash64(_key(F.col("source"))), F.lit(n_buckets)).cast("int"),
                "digest": F.sha2(dedup_key(F.col("text")).cast("binary"), 256),
            }
        )
        return own.where(blank(F.col("text")).rlike(r"\S"))

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Writes rows by bucket; a large bucket is split into several files by the engine."""
        name = uuid.uuid4().hex
        folder = f"{self.root}/data/{name}"
        rows.hint("rebalance", "bucket").withColumn("b", F.col("bucket")).write.partitionBy("b").parquet(folder)
        written = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        return {int(n[2:]): f"{name}/{n}" for n in written if n.startswith("b=")}

    def _replace(self, base: Manifest, touched: list[int], rows: DataFrame, schema: StructType) -> Manifest:
        new = self._write(rows)
        files = {b: f for b, f in base.files.items() if b not in touched} | new
        try:
            return self._commit(base, schema, files)
        except CommitConflict:
            for folder in {f.split("/")[0] for f in new.values()}:
                self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)
            raise

    def upsert(self, incoming: DataFrame, incremental: bool = True, base: Manifest | None = None) -> Manifest:
        """Commits the store with the sources of a batch replaced, or the batch alone if not incremental.

        ``base``: the version to build on, the last one by default; ``CommitConflict`` if it is not the last any more.
        """
        if incoming.isEmpty():
            raise ValueError("no chunks to add")
        base = base or self.manifest()
        n = base.n_buckets if base else self.n_buckets
        batch = self._placed(incoming, n)
        if base is None:
            return self._commit(None, incoming.schema, self._write(batch))
        if not incremental:
            return self._replace(base, list(base.files), batch, incoming.schema)
        store = self._read(base)
        coming = incoming.select(_key(F.col("source")).alias("norm")).distinct()
        narrow = store.select("bucket", "digest", "ingest_seq", _key(F.col("source")).alias("norm")).join(coming, "norm", "left_anti")
        firsts = narrow.groupBy("digest").agg(F.min("ingest_seq").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = narrow.join(firsts, "digest").where("ingest_seq > first").select("bucket", "digest", "ingest_seq")
        own = coming.select(F.pmod(F.xxhash64("norm"), F.lit(n)).cast("int").alias("bucket"))
        touched = sorted(r.bucket for r in own.union(later.select("bucket")).distinct().collect())  # n_buckets at most
        rows = self._read(base, touched).withColumn("norm", _key(F.col("source")))
        rows = rows.join(coming, "norm", "left_anti").drop("norm").join(later, ["bucket", "digest", "ingest_seq"], "left_anti")
        return self._replace(base, touched, rows.select(*store.columns).unionByName(batch.select(*store.columns)), incoming.schema)

    def delete(self, selector: Selector, data_root: str = "") -> Manifest:
        """Commits the store without the selected chunks; one bucket is rewritten."""
        base = self.manifest()
        if base is None:
            raise ValueError("there is no store")
        store = self._read(base)
        names = sources_of(store, selector.metadata, data_root) if selector.metadata else [selector.source]
        asked = self.spark.createDataFrame([(x,) for x in names], "source string").select(_key(F.col("source")).alias("norm"))
        keys = asked.select("norm", F.pmod(F.xxhash64("norm"), F.lit(base.n_buckets)).cast("int").alias("bucket")).collect()
        touched = sorted({r.bucket for r in keys})
        left = self._read(base, touched).where(~selected(selector, [r.norm for r in keys]))
        return self._replace(base, touched, left, StructType.fromJson(json.loads(base.schema)))

    def vacuum(self, keep: int = 10) -> int:
        """Deletes all versions but the last ``keep``, and data that none of those names; the number of folders deleted.

        No writer may be at work: what it has not committed yet is named by no version.
        """
        known = self.versions()
        kept = {f.split("/")[0] for v in known[-keep:] for f in self.manifest(v).files.values()}
        for v in known[:-keep]:
            self._fs.delete(self._path(self._log(v)), False)
        folders = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/data"))]
        gone = [f for f in folders if f not in kept]
        for f in gone:
            self._fs.delete(self._path(f"{self.root}/data/{f}"), True)
        return len(gone)
