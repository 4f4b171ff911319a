import zlib

import numpy as np
import pytest

from lodestream.llm import quality_classifier as qc

SCHEMA = "doc_id long, text string, lang string, row string, key int"


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = documents(spark)
    rows = qc.quality_report(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert len(held) > 60 and np.mean([r.predicted == r.quality for r in held]) >= 0.97


def test_labels_of_the_held_out_part_have_no_effect(spark):
    from pyspark.sql import functions as F

    docs, labels = documents(spark)
    flipped = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in qc.quality_report(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    good, bad = "some plain words of a text, as they come. ", "XX!! YY!! ZZ!! "
    rows = [(i, (good if i % 2 else bad) * (i + 2), "en", "x", 1) for i in range(40)]
    rows += [(100, None, "en", "x", 1), (101, "", None, None, None), (102, " \n", "en", "x", 1), (None, good * 3, "en", "x", 1), (1, good * 3, "en", "x", 1), (103, good * 20_000, "en", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (5, 1), (9_999, 0)], "doc_id long, quality int")
    out = qc.quality_report(docs, labels).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    assert [by_id[i].score for i in (100, 101, 102)] == [0, 0, 0]
    assert by_id[103].predicted == 1 and by_id[None].predicted == 1 and not by_id[None].held_out
    assert all(by_id[i].predicted == i % 2 for i in range(40))
    kept = qc.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in out if r.predicted)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0)]])
def test_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b c", "en", "x", 1), (3, "d e f", "en", "x", 1)], SCHEMA)
    scores = {r.score for r in qc.quality_report(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert scores == {0.5 if not labels else float(labels[0][1])}
    assert qc.quality_report(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).collect() == []


def test_votes_match_a_plain_loop():
    rng = np.random.default_rng(3)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, qc.DIMENSIONS)).astype(np.float32))
    model = qc.Model(np.ones(1), np.ones((1, 1)), unit(200), rng.integers(0, 2, 200).astype(float))
    texts = unit(700)
    want = []
    for t in texts:
        cosine = model.vectors @ t
        near = np.argsort(-cosine)[: qc.NEIGHBOURS]
        w = np.maximum(cosine[near], 1e-6).astype(float) ** 8
        want.append((w * model.labels[near]).sum() / w.sum())
    assert np.allclose(model.vote(texts), want, atol=1e-5)
