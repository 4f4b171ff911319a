"""Each stage on its own input, against plain versions."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestream.llm.sentencepiece import MODEL_PATH, Codec, Model
from lodestream.llm.near_copies import drop_near_copies

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b if not a or not b else len(a & b) >= 0.8 * len(a | b)


def plain_near(rows):
    """doc_ids that stay, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]) and root(i) != root(j):
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return {min(g) for g in groups.values()}


def edited(rng, words, n, vocabulary):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = str(rng.choice(vocabulary))
    return " ".join(out)


def test_near_copies_at_point_eight(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows, d = [], 0
    for g in range(60):
        body = rng.choice(vocabulary, 300).tolist()
        for k in range(5):
            rows.append((d, edited(rng, body, 2 * k, vocabulary)))
            d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, "one two"), (d + 3, "ONE  two"), (d + 4, "one three")]
    df = spark.createDataFrame([(a, b, "x", "y", 1) for a, b in rows], "doc_id long, text string, node string, text_hash string, fp int")
    out = drop_near_copies(df)
    assert out.columns == df.columns
    got, want = {r.doc_id for r in out.collect()}, plain_near(rows)
    # Whatever goes is like one that stays or goes with it; of what should go, next to nothing is missed.
    assert not want - got and len(got - want) <= 0.02 * (len(rows) - len(want))
    assert drop_near_copies(df.limit(0)).collect() == []


def test_a_dense_group_leaves_one(spark):
    rng = np.random.default_rng(12)
    vocabulary = [f"v{i}" for i in range(500)]
    body = rng.choice(vocabulary, 400).tolist()
    rows = [(i, edited(rng, body, 2, vocabulary)) for i in range(300)] + [(1000 + i, " ".join(rng.choice(vocabulary, 80))) for i in range(50)]
    out = {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0} | {1000 + i for i in range(50)}


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, codec = docs.columns, Codec(Model.parse(open(MODEL_PATH, "rb").read()))
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, DATA)
        held[name] = (before, docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(held[name][1], docs.schema)
    before, after = held["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert np.mean([(r.doc_id in gone) == (labels[r.doc_id] == 0) for r in before if r.doc_id in labels]) >= 0.95
    before, after = held["exact dedup"]
    key = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
    assert Counter(map(key, after)) == Counter({key(r) for r in before})
    before, after = held["SimHash near-dedup"]
    assert {r.doc_id for r in after} == plain_near([(r.doc_id, r.text) for r in before])
    before, after = held["mixing sources"]
    size = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
    assert size(after) == pytest.approx(1.5 * size(before), rel=0.02)
    before, after = held["SentencePiece encoding"]
    assert Counter((r.doc_id, tuple(codec.encode(r.text).tolist())) for r in before) == Counter((r.doc_id, tuple(r.ids)) for r in after)
    assert all(r.round_trip for r in after)


def test_reruns_agree(spark):
    once, again = (sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect()) for _ in range(2))
    assert once == again and len(once) > 0
