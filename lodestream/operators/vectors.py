"""Vector search by blocked products: one scan for a bounded set of queries, or an index of cells.

Vectors are compared by cosine, rounded to six places; of equal scores the smaller id comes first. A batch of vectors
meets the queries in matrix products of bounded size. The index files each vector under the nearest of some centroids, fitted on
a bounded sample; a cell is stored in a folder of its own, in blocks of bounded size, so a cell that holds a third
of all rows is many blocks. By the triangle inequality on angles no member of a cell can be nearer to a query than
the angle to the centroid less the cell's widest angle. ``search`` looks into the nearest cells first, and then
into every cell whose bound does not rule out a better hit, so it is exact; with ``probes`` it stops at the
nearest cells.

Defined results: null vectors are left out; a zero vector has cosine 0 to all, and is looked at for every query;
fewer than k vectors give fewer hits; empty tables give empty results; further columns of the chunks are carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestream.storage import materialize, new_folder

#: Vectors that centroids are fitted on, at most.
SAMPLE_ROWS = 1 << 16
#: Cells of an index, at most; a cell should hold some thousand vectors.
MAX_CELLS = 4096
CELL_ROWS = 1 << 10
#: Vectors, and queries, of one block.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 13, 1 << 10
#: Scores of rows by queries that are held at a time.
BLOCK_SCORES = 1 << 20
#: Cells that an exact search looks into before it uses the bounds.
FIRST_PROBES = 4
FIT_ROUNDS = 12
#: Zero vectors have no direction; they are a cell of their own.
NO_CELL = -1
_SLACK = 2e-6  # scores are rounded
_OWN = ("cell", "part", "block", "angle")

Hits = tuple[pa.Table, np.ndarray, np.ndarray]  # carried columns, query numbers, scores


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length, but for zero rows."""
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1.0, length)


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1)))


def _candidates(scores: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and queries of a block (rows x queries) that may be among the best k: ties at the limit stay in."""
    hit = scores >= least
    if len(scores) > k and np.count_nonzero(hit) > 2 * k * scores.shape[1]:
        hit &= scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    return np.nonzero(hit)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the ids."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return column.to_numpy()
    return column.to_pandas().rank(method="dense").to_numpy()


def _best(hits: Hits, k: int, id_col: str) -> Hits:
    table, query, score = hits
    order = np.lexsort((_ids(table.column(id_col)), -score, query))
    sorted_ = query[order]
    kept = order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < k]
    return table.take(pa.array(kept)), query[kept], score[kept]


class _Best:
    """The best ``k`` hits of a block of queries (unit rows) among the rows met so far.

    At most about ``BLOCK_SCORES`` scores are held at a time, however many the rows of a batch and the queries.
    """

    def __init__(self, queries: np.ndarray, k: int, id_col: str) -> None:
        self.queries, self.k, self.id_col = queries, k, id_col
        self.hits: Hits | None = None
        self.least = np.full(len(queries), -np.inf)
        self.last: np.ndarray | None = None  # the id at the limit, where ids are integers

    def add(self, rows: pa.Table, vectors: np.ndarray) -> None:
        """Meets rows (carried columns) and their unit vectors."""
        step = max(self.k + 1, BLOCK_SCORES // max(len(self.queries), 1))
        for at in range(0, len(vectors), step):
            scores = vectors[at : at + step] @ self.queries.T
            np.round(scores, 6, out=scores)
            row, of = _candidates(scores, self.k, self.least)
            score, row = scores[row, of], row + at
            if self.last is not None:
                ids = _ids(rows.column(self.id_col))
                before = (score > self.least[of]) | (ids[row] < self.last[of])
                row, of, score = row[before], of[before], score[before]
            if len(row):
                self._keep((rows.take(pa.array(row)), of, score))

    def _keep(self, found: Hits) -> None:
        if self.hits is not None:
            held = self.hits
            found = pa.concat_tables([held[0], found[0]]), np.append(held[1], found[1]), np.append(held[2], found[2])
        self.hits = table, query, score = _best(found, self.k, self.id_col)
        count = np.bincount(query, minlength=len(self.queries))
        full, end = count >= self.k, np.cumsum(count) - 1
        self.least[full] = score[end[full]]
        ids = table.column(self.id_col)
        if pa.types.is_integer(ids.type) and not ids.null_count:
            self.last = np.zeros(len(self.queries), dtype=np.int64)
            self.last[full] = _ids(ids)[end[full]]
        else:
            self.last = None


def _carried(chunks: DataFrame, vector: str) -> list[str]:
    return [c for c in chunks.columns if c != vector and c not in _OWN]


def _hit_schema(queries: DataFrame, chunks: DataFrame, carried: list[str]) -> StructType:
    return StructType([queries.schema["query_id"], *[chunks.schema[c] for c in carried], StructField("vector_score", DoubleType())])


def _as_table(hits: Hits, names: pa.Array) -> pa.Table:
    table, query, score = hits
    return table.add_column(0, "query_id", names.take(pa.array(query))).append_column("vector_score", pa.array(score, pa.float64()))


def scan_top_k(queries: DataFrame, chunks: DataFrame, k: int, id_col: str, vector: str = "embedding") -> DataFrame:
    """The best ``k`` hits of each task for each of the queries (query_id, query_vector), a set of bounded size
    that the caller has checked: (query_id, columns of the chunks, vector_score). One scan, no shuffle."""
    asked = queries.where("query_vector IS NOT NULL").select("query_id", "query_vector").toArrow()
    carried = _carried(chunks, vector)
    schema = _hit_schema(queries, chunks, carried)
    if not asked.num_rows:
        return chunks.sparkSession.createDataFrame([], schema)
    q, names = _matrix(asked["query_vector"]), asked["query_id"].combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(at, _Best(q[at : at + BLOCK_QUERIES], k, id_col)) for at in range(0, len(q), BLOCK_QUERIES)]
        for batch in batches:
            rows, vectors = pa.Table.from_batches([batch]).select(carried), _matrix(batch.column(vector))
            if batch.num_rows:
                for _, best in held:
                    best.add(rows, vectors)
        while held:
            at, best = held.pop()
            if best.hits is not None:
                yield from _as_table(best.hits, names.slice(at, BLOCK_QUERIES)).combine_chunks().to_batches()

    return chunks.where(F.col(vector).isNotNull()).select(*carried, vector).mapInArrow(run, schema)


def fit_centroids(sample: np.ndarray, n_cells: int, rounds: int = FIT_ROUNDS, seed: int = 0) -> np.ndarray:
    """Directions that the unit rows of a sample gather around."""
    rng = np.random.default_rng(seed)
    rows = sample[np.abs(sample).sum(axis=1) > 0]
    if not len(rows):
        return np.zeros((0, sample.shape[1]))
    centers = np.unique(rows[rng.permutation(len(rows))[:n_cells]], axis=0)
    for _ in range(rounds):
        own = (rows @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 1e-12, sums / np.where(length > 1e-12, length, 1.0), centers)
    return centers


def _looked_up(values: dict[int, int], key: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(key))


@dataclass
class CellIndex:
    """Vectors by cell and block in ``members``; centroids, and by cell the widest angle and the number of blocks."""

    members: DataFrame
    id_col: str
    vector: str
    centroids: np.ndarray
    angles: dict[int, float]
    parts: dict[int, int]

    def _cells_of(self, queries: DataFrame, choose: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
        """A row for each query and cell to look into; ``choose`` gets angles, bounds on cosines, and the queries."""
        cells = np.array(sorted(c for c in self.angles if c != NO_CELL), dtype=np.int64)
        widest = np.array([self.angles[c] for c in cells])
        centers, zeros = self.centroids[cells], NO_CELL in self.angles
        columns = ["query_id", "query_vector"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column("query_vector"))
                angle = np.arccos(np.clip(q @ centers.T, -1, 1)) if len(cells) else np.zeros((len(q), 0))
                bound = np.cos(np.maximum(angle - widest, 0))
                bound[np.abs(q).sum(axis=1) == 0] = 1.0
                row, at = np.nonzero(choose(angle, bound, batch))
                row, cell = row, cells[at]
                if zeros:
                    row, cell = np.append(row, np.arange(len(q))), np.append(cell, np.full(len(q), NO_CELL))
                yield batch.select(columns).take(pa.array(row)).append_column("cell", pa.array(cell, pa.int64()))

        schema = StructType([queries.schema[c] for c in columns]).add("cell", "long")
        return queries.mapInArrow(run, schema)

    def _look(self, pairs: DataFrame, k: int, n_queries: int) -> DataFrame:
        """Best k hits of each query in each block of the cells it is paired with."""
        opened = [r.cell for r in pairs.select("cell").distinct().collect()]  # cells are bounded
        carried, id_col, vector = _carried(self.members, self.vector), self.id_col, self.vector
        schema = _hit_schema(pairs, self.members, carried)
        groups = max(1, -(-n_queries // BLOCK_QUERIES))
        asked = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), _looked_up(self.parts, "cell") - 1)))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        rows = self.members.where(F.col("cell").isin(opened)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def meet(members: pa.Table, queries: pa.Table) -> pa.Table:
            rows, names = members.select(carried), queries["query_id"].combine_chunks()
            hits: Hits | None = None
            if members.num_rows and queries.num_rows:
                best = _Best(_matrix(queries["query_vector"]), k, id_col)
                best.add(rows, _matrix(members[vector]))
                hits = best.hits
            none = rows.slice(0, 0), np.zeros(0, int), np.zeros(0)
            return _as_table(hits or none, names if isinstance(names, pa.Array) else pa.array([], names.type))

        on = ("cell", "part", "block")
        return rows.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(meet, schema)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, columns of the chunks, vector_score) for queries (query_id, query_vector), of any number: the best
        ``k`` of each query, and others, at most ``k`` a block. Exact, or of the nearest ``probes`` cells only."""
        queries = queries.where("query_vector IS NOT NULL").select("query_id", "query_vector")
        if not self.angles:
            return queries.sparkSession.createDataFrame([], _hit_schema(queries, self.members, _carried(self.members, self.vector)))
        n = queries.count()
        first = probes or FIRST_PROBES

        def nearest(angle: np.ndarray, bound: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            return angle.argsort(axis=1, kind="stable").argsort(axis=1) < first

        pairs = materialize(self._cells_of(queries, nearest), "vector-pairs")
        hits = self._look(pairs, k, n)
        if probes:
            return hits
        hits = materialize(hits, "vector-hits")
        # The k-th best so far; a cell that cannot reach it stays closed.
        ranked = hits.groupBy("query_id").agg(F.sort_array(F.collect_list("vector_score"), False).alias("s"))
        best = ranked.select("query_id", F.get("s", F.lit(k - 1)).alias("least"))

        def others(angle: np.ndarray, bound: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            least = batch.column("least").fill_null(-2.0).to_numpy(zero_copy_only=False)[:, None]
            return ~nearest(angle, bound, batch) & (bound >= least - _SLACK)

        more = self._cells_of(queries.join(best, "query_id", "left"), others).where(F.col("cell") != NO_CELL)
        more = materialize(more, "vector-pairs")
        return hits.unionByName(self._look(more, k, n))


def build_index(chunks: DataFrame, id_col: str, vector: str = "embedding", n_cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> CellIndex:
    """Files all ``chunks`` by cell. Centroids are fitted on the ``sample_rows`` vectors whose hashed ids are least."""
    spark = chunks.sparkSession
    rows = chunks.where(F.col(vector).isNotNull())
    n = rows.count()
    n_cells = n_cells or max(1, min(MAX_CELLS, n // CELL_ROWS))
    picked = rows.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).select(vector).limit(min(sample_rows, max(n, 1))).toArrow()
    centroids = fit_centroids(_matrix(picked[vector]), n_cells, seed=seed) if n else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(vector))
            zero = np.abs(v).sum(axis=1) == 0
            near = np.clip(v @ centroids.T, -1, 1) if len(centroids) else np.ones((len(v), 1))
            cell = np.where(zero, NO_CELL, near.argmax(axis=1))
            angle = np.where(zero, 0.0, np.arccos(near.max(axis=1)))
            yield batch.append_column("cell", pa.array(cell, pa.int64())).append_column("angle", pa.array(angle))

    schema = StructType([*rows.schema.fields]).add("cell", "long").add("angle", "double")
    filed = materialize(rows.mapInArrow(run, schema), "vector-filed")
    cells = filed.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()  # MAX_CELLS at most
    parts = {r.cell: -(-r.n // BLOCK_ROWS) for r in cells}
    n_parts = _looked_up(parts, "cell") if parts else F.lit(1)
    placed = filed.drop("angle").withColumn("part", F.pmod(F.xxhash64(id_col), n_parts).cast("int"))
    folder = new_folder(spark, "vector-cells")
    placed.repartition("cell", "part").write.partitionBy("cell").parquet(folder)
    members = spark.read.schema(placed.schema).parquet(folder)
    # Angles come out of rounded products: a little room keeps the bound on the safe side.
    return CellIndex(members, id_col, vector, centroids, {r.cell: r.angle + 1e-7 for r in cells}, parts)
