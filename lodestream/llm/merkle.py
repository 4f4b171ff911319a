"""Merkle manifest of a dataset: every row a leaf, a tree for each source, one root over the sources.

Leaves are written as sorted runs. The node store is a folder of Parquet with a part for each level
(``level=1``, ``level=2`` ...); each level is made by one scan of the level before it, whose nodes meet in threes by
their coordinate (tree, position div 3), so no task holds more of a tree than its share of nodes, whatever the size
of a source. A node keeps its run, the digests below it. Proofs go down the same levels: a level joined with the one
above it by coordinate, as two scans in step, gives each run the siblings of its own way up, and the leaves meet
the lowest level only. What lies above a run is written once for the run, not for each of its leaves.

Defined results: any column may be null (``-``); of a null doc_id nothing is tampered with, and it comes first;
rows that are equal have equal leaves, each with a place and a proof of its own, in any order among themselves;
a null source is a source, before the others; an empty text is ``0:``; an empty table gives an empty result;
further columns are left alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.order import numbered, sorted_runs
from lodestream.storage import materialize, new_folder, scratch

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, pos long, size long, digest string, run array<string>"


def digest(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Each value as its length in bytes and itself, so that no two rows run together alike."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return digest(F.concat(*parts))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    text = lambda b: F.lower(F.hex(b))
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(text(s["left"]), acc, text(s["right"]))))


def proof_digest(path: Column) -> Column:
    return digest(F.lower(F.array_join(F.transform(path, lambda s: F.concat(F.hex(s["left"]), F.hex(s["right"]))), "")))


@dataclass
class NodeStore:
    """The levels above some leaves (tree, pos, size, digest), in ``folder``."""

    spark: SparkSession
    folder: str
    height: int

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema(NODE).parquet(f"{self.folder}/level={k}")

    def subroots(self, leaves: DataFrame) -> DataFrame:
        """(tree, digest, level): where each tree ends; a lone leaf is its tree."""
        ends = leaves.where("size = 1").select("tree", "digest", F.lit(0).alias("level"))
        if not self.height:
            return ends
        nodes = self.spark.read.schema(NODE + ", level int").option("basePath", self.folder).parquet(self.folder)
        return ends.unionByName(nodes.where("size = 1").select("tree", "digest", "level"))


def build(leaves: DataFrame) -> NodeStore:
    """Levels above ``leaves`` (tree, pos, size, digest), a table that is written; each reads the one before."""
    spark = leaves.sparkSession
    most = leaves.agg(F.max("size")).first()[0] or 0
    folder, height, below = new_folder(spark, "merkle-nodes"), 0, leaves
    while most > 1:
        height, most = height + 1, -(-most // ARITY)
        runs = below.where("size > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("pos"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"))
        nodes = runs.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]).alias("run"))
        nodes = nodes.select("tree", "pos", "size", digest(F.array_join("run", "")).alias("digest"), "run")
        nodes.write.parquet(f"{folder}/level={height}")
        below = NodeStore(spark, folder, height).level(height)
    return NodeStore(spark, folder, height)


def siblings(run: Column, pos: Column) -> Column:
    """What stands beside a node in its run, as bytes."""
    at = F.pmod(pos, F.lit(ARITY)).cast("int")
    side = lambda part: F.unhex(F.array_join(part, ""))
    return F.struct(side(F.slice(run, F.lit(1), at)).alias("left"), side(F.slice(run, at + 2, F.lit(ARITY))).alias("right"))


def paths(store: NodeStore, leaves: DataFrame, above: DataFrame) -> DataFrame:
    """``leaves`` with ``path``, their siblings from the leaf up, and the further columns of ``above``.

    ``above``: (tree, level, path, ...) for each tree, with the level where it ends and what lies over that.
    """
    spark = leaves.sparkSession
    extra = [c for c in above.columns if c not in ("tree", "level", "path")]
    up = None  # (tree, pos, run, path, extra): the runs of the level above, each with its own path

    def climb(rows: DataFrame, k: int) -> DataFrame:
        ends = rows.where("size = 1").join(above.where(F.col("level") == k).drop("level"), "tree")
        if up is None:
            return ends
        to = up.select("tree", F.col("pos").alias("over"), F.col("run").alias("beside"), F.col("path").alias("rest"), *extra)
        inner = rows.where("size > 1").withColumn("over", F.expr(f"pos div {ARITY}")).join(to, ["tree", "over"])
        path = F.concat(F.array(siblings(F.col("beside"), F.col("pos"))), "rest")
        return inner.withColumn("path", path).drop("over", "beside", "rest").unionByName(ends)

    for k in range(store.height, 0, -1):
        rows = climb(store.level(k).drop("digest"), k)
        folder = new_folder(spark, f"merkle-paths-{k}")
        rows.drop("size").write.parquet(folder)
        up = spark.read.schema(rows.drop("size").schema).parquet(folder)
    return climb(leaves, 0)


def manifest(rows: DataFrame) -> DataFrame:
    """Leaves with proofs: ``rows`` (doc_id, source, leaf, carried) as (doc_id, leaf, carried, subroot, root, path).

    ``carried`` is any one column that is to stay with its leaf.
    """
    spark = rows.sparkSession
    rows = materialize(
        rows.select(
            # Sorts as the source does, bytewise, and is never null.
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), "doc_id", F.col("leaf").alias("digest"), "carried",
        ),
        "merkle-rows",
    )
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    runs = sorted_runs(rows, F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("uid"), label="merkle-runs").drop("uid")
    leaves = materialize(numbered(runs, "tree"), "merkle-leaves")
    store = build(leaves)
    ends = materialize(store.subroots(leaves), "merkle-subroots")

    tops = sorted_runs(ends.select(F.lit("").alias("top"), F.col("tree").alias("source"), "digest"), "top", "source", label="merkle-sources")
    tops = materialize(numbered(tops, "top").withColumnRenamed("top", "tree"), "merkle-source-leaves")
    over = build(tops)
    root = over.subroots(tops).select(F.lit("").alias("tree"), "level", F.col("digest").alias("root"))
    no_path = F.array().cast("array<struct<left:binary,right:binary>>")
    to_root = paths(over, tops, root.withColumn("path", no_path)).select(F.col("source").alias("tree"), "path", "root")
    above = ends.withColumnRenamed("digest", "subroot").join(to_root, "tree")
    above = materialize(above, "merkle-above")
    return paths(store, leaves, above).select("doc_id", F.col("digest").alias("leaf"), "carried", "subroot", "root", "path")


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each of ``docs``.

    Where 2 divides the crc32 of the decimal doc_id, the leaf that is folded is that of a text without its line ends.
    """
    spark = docs.sparkSession
    col = {c: F.col(c) for c in FIELDS}
    bare = F.translate(col["text"], "\n", "")
    hit = F.coalesce(F.crc32(col["doc_id"].cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains(col["text"], F.lit("\n"))
    tampered = F.when(hit, leaf_digest(*[bare if c == "text" else col[c] for c in FIELDS]))
    rows = docs.select("doc_id", "source", leaf_digest(*col.values()).alias("leaf"), tampered.alias("carried"))
    with scratch(spark):
        proofs = manifest(rows)
        folded = proofs.select(
            "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("carried", "leaf"), F.col("path")).alias("folded_root")
        )
        return materialize(folded.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-manifest", keep=True)
