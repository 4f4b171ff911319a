"""Vector search against all pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lodestream.operators import retrieval, vectors
from lodestream.plans.retrieval_queries import QUERIES


def table(spark, rows, ids=None):
    data = [(i if ids is None else ids[i], None if v is None else [float(x) for x in v], f"l{i % 3}") for i, v in enumerate(rows)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, tag string")


def plain(queries, rows, k):
    """(query, vec_id, score, rank) by looking at all pairs."""
    out = []
    for q, qv in queries:
        scored = []
        for i, v in rows:
            a, b = np.float32(qv).astype(float), np.float32(v).astype(float)
            size = (np.linalg.norm(a) or 1.0) * (np.linalg.norm(b) or 1.0)
            scored.append((-round(float(a @ b / size), 6), i))
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def clustered(n, dim=8, groups=12, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    rows = centers[rng.integers(groups, size=n)] + 0.15 * rng.normal(size=(n, dim))
    rows[n // 2 : n // 2 + n // 3] = rows[0]  # a third of all vectors are one
    rows[5] = 0
    return [r.tolist() for r in rows]


def got(df):
    return sorted((r.query_id, r.vec_id, r.vector_score, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def data(spark):
    rows = clustered(900)
    ask = [(10, rows[0]), (11, rows[7]), (12, rows[5]), (13, [1.0] * 8), (14, (-np.array(rows[20])).tolist())]
    queries = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in ask], "query_id long, query_vector array<float>")
    return rows, ask, table(spark, rows).repartition(5), queries


def test_one_scan(spark, data):
    rows, ask, chunks, queries = data
    out = retrieval.top_k(queries, chunks, 7)
    assert got(out) == plain(ask, list(enumerate(rows)), 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("NestedLoop", "CartesianProduct"))
    assert set(out.columns) == {"query_id", "vec_id", "tag", "vector_score", "rank"}


def test_more_queries_than_one_scan_takes(spark, data, monkeypatch):
    rows, ask, chunks, queries = data
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 2)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 2)
    assert got(retrieval.top_k(queries, chunks, 7)) == plain(ask, list(enumerate(rows)), 7)


@pytest.mark.parametrize("k", [1, 7, 400])
def test_an_index_is_exact(spark, data, monkeypatch, k):
    rows, ask, chunks, queries = data
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    index = vectors.build_index(chunks, "vec_id", n_cells=16)
    assert sum(index.parts.values()) > 16 and vectors.NO_CELL in index.parts
    assert got(retrieval.search(index, queries, k)) == plain(ask, list(enumerate(rows)), k)


def test_bounds_close_cells(spark, data):
    _, _, chunks, queries = data
    index = vectors.build_index(chunks, "vec_id", n_cells=12)
    seen = []
    look = index._look
    index._look = lambda pairs, k, n: seen.append(pairs.count()) or look(pairs, k, n)
    index.search(queries.where("query_id IN (10, 11)"), 5).count()
    assert len(seen) == 2 and seen[1] < 2 * (12 - vectors.FIRST_PROBES)


def test_recall_with_few_cells(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    queries = e.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    index = vectors.build_index(e, "vec_id", n_cells=16)
    exact = {(r.query_id, r.vec_id) for r in retrieval.top_k(queries, e, 8).collect()}
    few = {(r.query_id, r.vec_id) for r in retrieval.search(index, queries, 8, probes=12).collect()}
    print("recall", len(exact & few) / len(exact))
    assert len(exact & few) / len(exact) >= 0.9


def test_empty_and_null(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, query_vector array<float>")
    none = table(spark, [])
    some = table(spark, [[1, 0], None, [0, 1]])
    assert got(retrieval.top_k(queries, none, 3)) == [] and got(retrieval.top_k(queries.where("query_id > 5"), some, 3)) == []
    assert got(retrieval.top_k(queries, some, 3)) == [(1, 0, 1.0, 1), (1, 2, 0.0, 2)]
    assert got(retrieval.search(vectors.build_index(none, "vec_id"), queries, 3)) == []
    assert got(retrieval.search(vectors.build_index(some, "vec_id"), queries, 3)) == [(1, 0, 1.0, 1), (1, 2, 0.0, 2)]


@pytest.mark.parametrize("kind", [int, str])
def test_memory_goes_by_the_block_not_by_queries_and_rows(kind):
    rng = np.random.default_rng(3)
    rows, queries = (vectors.unit_rows(rng.normal(size=(n, 4))) for n in (6000, 1000))
    rows[1000:3000] = queries[:500] = rows[0]  # ties at the limit
    ids = [kind(i) for i in rng.permutation(len(rows)).tolist()]
    best = vectors._Best(queries, 8, "id")
    tracemalloc.start()
    for at in range(0, len(rows), 3000):
        best.add(pa.table({"id": ids[at : at + 3000]}), rows[at : at + 3000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The scores of a batch alone are 24 MB, and were held three times over.
    assert peak < 60 << 20
    table, query, score = best.hits
    all_scores = np.round(queries @ rows.T, 6)
    for q in (0, 499, 500, 999):
        want = sorted(zip((-all_scores[q]).tolist(), ids))[:8]
        assert list(zip((-score[query == q]).tolist(), table.filter(pa.array(query == q))["id"].to_pylist())) == want


@pytest.mark.parametrize("name", ["retrieval_context", "vector_threshold_context"])
def test_contexts_search_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
