"""Texts that repeat known ones, in blocks, held against every pair of texts."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.functions.overlap import core_sets, sets_cover
from lodestream.operators import repeats, session

WORDS = "where is the big red car shown and what does it cost in winter 多少 哪里 展厅 在 吗 。 ？ ok".split()


def rows(seed, n):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 6, 9]))) for _ in range(n // 2)] + [None, "", "x", "  "]
    return [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(texts), i) for i in range(n)]


def every_pair(hits, known, limit, earlier):
    k = known.select(F.col("visitor").alias("of"), F.col("seq").alias("at"), core_sets(F.col("text")).alias("known_sets"))
    near = F.col("visitor").eqNullSafe(F.col("of")) & (sets_cover(core_sets(F.col("text")), F.col("known_sets")) >= limit)
    near = near & (F.col("at") < F.col("seq")) if earlier else near
    return hits.join(k, near, "left_anti")


@pytest.mark.parametrize("block, slices", [(512, 512), (7, 5)])
def test_as_every_pair(spark, monkeypatch, block, slices):
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "SETS", slices)
    monkeypatch.setattr(repeats, "PAIRS", slices * 3)
    schema = "visitor long, seq int, text string, row int"
    hits, known = spark.createDataFrame(rows(1, 120), schema), spark.createDataFrame(rows(2, 90), schema)
    for limit in (0.32, 0.8, 1.0):
        got = sorted(r["row"] for r in session.drop_asked(hits, known, limit).collect())
        assert got == sorted(r["row"] for r in every_pair(hits, known, limit, False).collect()) and 0 < len(got) < 120
        got = sorted(r["row"] for r in session.drop_said(hits, known, limit).collect())
        assert got == sorted(r["row"] for r in every_pair(hits, known, limit, True).collect()) and 0 < len(got) < 120


def test_empty_tables(spark):
    schema = "visitor long, seq int, text string, row int"
    hits, none = spark.createDataFrame(rows(3, 20), schema), spark.createDataFrame([], schema)
    assert session.drop_asked(hits, none).count() == session.drop_said(hits, none).count() == 20
    assert session.drop_asked(none, hits).count() == 0
    assert session.drop_asked(hits, none).columns == hits.columns
