"""Operators that no query reaches: keys, registries, names, embeddings; quantiles and pair scores against plain ones."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions.text import json_stem, safe_tag, size_label, source_key
from lodestream.operators import reranking
from lodestream.operators.embedding import embed_column, hashed_bigrams, lexical_score
from lodestream.operators.retrieval import exact_quantiles, query_prefix
from lodestream.sources.files import latest_file, read_registry


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_source_keys(spark):
    given = ["data\\a.md", "./data/a.md", "../x/y", "/abs/a.md", "  b.md ", None, "/root/in/c.md", "...hidden"]
    assert one(spark, given, source_key) == ["data/a.md", "data/a.md", "x/y", "/abs/a.md", "b.md", "", "/root/in/c.md", "hidden"]
    assert one(spark, ["/root/in/c.md", "/root/inside"], lambda c: source_key(c, "/root/in/")) == ["c.md", "/root/inside"]
    assert one(spark, ["a/b/doc.json", "doc.json.json", "plain"], json_stem) == ["doc", "doc.json", "plain"]


def test_registries(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"./a\\b.md": "h1", "": "h2", "c.md": "", "d.md": "h4"}))
    bad.write_text("{nope")
    assert sorted(map(tuple, read_registry(spark, str(good)).collect())) == [("a/b.md", "h1"), ("d.md", "h4")]
    assert read_registry(spark, str(bad)).collect() == []


def test_latest_file(spark):
    files = spark.createDataFrame([("a.log", 3.0), ("b.log", 7.0), ("c.log", 5.0)], "path string, mtime double")
    assert latest_file(files).first().path == "b.log" and latest_file(files.limit(0)).first().path is None


def test_labels(spark):
    sizes = spark.createDataFrame([(10,), (2048,), (3 << 20,)], "n long")
    assert [r[0] for r in sizes.select(size_label(F.col("n"))).collect()] == ["10 B", "2.0 KB", "3.0 MB"]
    assert len(one(spark, ["a/b", "c d"], safe_tag)) == 2


def test_embeddings(spark):
    texts = ["some text", None, "", "some  TEXT", "other"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: np.array(r.v) for r in embed_column(df, "t", "v").collect()}
    want = hashed_bigrams([t or "" for t in texts])
    assert all(np.allclose(got[i], want[i]) for i in got) and np.allclose(got[0], got[3]) and not got[1].any()
    assert one(spark, ["x", "Find: x", "", None], lambda c: query_prefix(c, "Find: ")) == ["Find: x", "Find: x", "", None]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.88, 1.0])
def test_quantiles(spark, q):
    rng = np.random.default_rng(3)
    groups = {"one": [0.5], "two": [0.1, 0.9], "many": np.round(rng.random(501), 3).tolist(), "same": [0.25] * 300, "none": [None, None]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    got = {r.g: r.quantile for r in exact_quantiles(rows, "g", "v", q).collect()}
    assert set(got) == set(groups) - {"none"}
    assert all(abs(got[g] - float(np.quantile(groups[g], q))) < 1e-12 for g in got)


def test_pair_scores(spark):
    rows = [(0, "some query", "a text with some words"), (1, "some query", None), (2, "", "x"), (3, "q", "q"), (4, "long " * 5000, "long text"), (5, "ab", "xabx")]
    df = spark.createDataFrame(rows, "i int, q string, t string").repartition(2)
    got = reranking.score_pairs(df, "q", "t", "s").withColumn("lexical", lexical_score(F.col("q"), F.col("t"))).collect()
    assert len(got) == len(rows) and all(abs(r.s - r.lexical) < 1e-12 for r in got)
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda q, t: [float(len(a)) for a in q]

    out = reranking.score_pairs(spark.range(50_000, numPartitions=3).selectExpr("id", "repeat('x', cast(id % 90 as int)) AS q", "'t' AS t"), "q", "t", "s", load)
    assert out.where("s <> id % 90").count() == 0 and loads.value == 3
    assert reranking.score_pairs(df.limit(0), "q", "t", "s").collect() == []


def test_micro_batches():
    lengths = np.array([5, 100_000, 7, 6, 30_000, 30_000, 40_000, 5])
    batches = [b.tolist() for b in reranking.micro_batches(lengths, 3, 1 << 16)]
    assert sorted(i for b in batches for i in b) == list(range(8))
    assert batches == [[0, 7, 3], [2, 4], [5], [6], [1]]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 1, "red apple", "green pear"), (1, 2, "red apple", "red apple"), (1, 3, "red apple", "an apple"), (2, 1, "x", None)], "query_id int, rank int, query string, text string")
    out = sorted((r.query_id, r["rank"], r.text) for r in reranking.rerank_texts(hits, 2).collect())
    assert out == [(1, 1, "red apple"), (1, 2, "an apple"), (2, 1, None)]
