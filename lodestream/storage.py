"""Reading input tables and cutting lineage in a folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows sent to Python at a time hold about this many bytes, and Parquet's reader holds this many rows; texts are long rows.
BATCH_BYTES, READ_ROWS = 4 << 20, 512

_own_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_scopes: list[list[str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or set on the context.

    Where neither is, a folder of our own: a temporary one if all of Spark runs in this process, else below
    the warehouse, which must then be in a store that all executors share; a local path is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _own_dirs:
        set_before = sc.getCheckpointDir()
        if set_before:
            _own_dirs[app] = set_before.rstrip("/")
        elif sc.master.split("[")[0] == "local":
            _own_dirs[app] = tempfile.mkdtemp(prefix="lodestream-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if warehouse.split(":")[0] == "file" or ":" not in warehouse:
                raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse, {warehouse}, is another disk on each node")
            _own_dirs[app] = f"{warehouse}/lodestream-{app}"
    return _own_dirs[app]


def bound_batches(spark: SparkSession) -> None:
    """Sees to it that a batch of texts sent to Python is bounded in bytes, not in rows alone, and one read from Parquet in rows."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = spark.conf.get(name).lower().rstrip("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(name, most)


def materialize(df: DataFrame, label: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in a folder for each value of ``by``, and read it back.

    A lost executor then costs a reread of finished files, not a recomputation of
    everything above, and what is read twice is computed once. What is written inside a
    ``scratch`` block goes when the block ends; with ``keep``, when the block around that does.
    """
    spark = df.sparkSession
    path = new_folder(spark, label, keep)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A path in the shared folder that nothing has yet; what is written there goes as ``materialize`` says."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    else:
        app = spark.sparkContext.applicationId
        if app not in _written:
            _written[app] = []
            atexit.register(_release_at_exit, spark)
        _written[app].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; nothing that reads them may be returned."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.pop())


def release(spark: SparkSession) -> None:
    """Deletes what ``materialize`` has written in this session; results read from it must be done with."""
    _delete(spark, _written.pop(spark.sparkContext.applicationId, []))
    _written[spark.sparkContext.applicationId] = []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def _release_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        release(spark)
