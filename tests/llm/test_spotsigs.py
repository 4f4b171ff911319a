"""Spot signatures against a plain version, and against their SQL."""

import hashlib
import re

import duckdb
import pytest

from lodestream.llm import spotsigs

SCHEMA = "doc_id long, text string, key string, sigs int, next string, pos long"
PYTHON_NODES = ("Python", "Pandas", "Arrow")


def plain_set(text):
    ws = re.findall(r"[^\W_]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    common = lambda w: len(w) == 1 or w in spotsigs.COMMON or (ord(w[0]) + ord(w[-1]) + len(w)) % 6 == 0
    chains = []
    for i in range(-1, len(ws)):
        if ws and (i < 0 or common(ws[i])):
            content = [w for w in ws[i + 1 :] if not common(w)][: spotsigs.CHAIN] if len(ws) < 3000 else None
            if content is None:
                content, k = [], i + 1
                while k < len(ws) and len(content) < spotsigs.CHAIN:
                    content += [ws[k]] * (not common(ws[k]))
                    k += 1
            chains.append(" ".join(["^" if i < 0 else ws[i], *content]))
    return {hashlib.md5(c.encode()).hexdigest()[:8] for c in chains}


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b or min(len(a), len(b)) / max(len(a), len(b)) < spotsigs.LEAST / spotsigs.PARTITION_FACTOR**2:
        return 0.0
    return len(a & b) / len(a | b)


def plain_report(rows):
    rows = [(d, t or "") for d, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest())
    order = sorted(set(rows), key=key)
    out = []
    for r in rows:
        d, t = r
        after = order[(order.index(r) + 1) % len(order)][1]
        take = len(t) // 4
        edited = t[: len(t) - take] + after[:take]
        a, b, c = plain_set(t), plain_set(edited), plain_set(after)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(b)), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=repr)


def report(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in rows], SCHEMA).repartition(parts)
    out = spotsigs.fingerprint_report(df)
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in PYTHON_NODES)
    return sorted((tuple(r)[:7] for r in out.collect()), key=repr)


ROWS = [
    (1, "The quick fox is on the way to a house, and of all the houses it was the best."), (2, None), (3, ""), (4, " \n\t"), (5, "the of and"), (6, "word"), (7, "É été À la maison l'été 😀 x2 B"),
    (7, "another text of the same number"), (8, "The same text as before in the same words."), (9, "The same text as before in the same words."), (9, "The same text as before in the same words."), (None, "a null id of some text"), (None, "a null id of some text"), (None, "zz"),
    (12, "of the long text with many different words " * 30 + "end"), (13, " ".join(f"the w{i} v{i}" for i in range(6000))), (-5, "先 一 二 the 三四"),
]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_report(spark, rows):
    assert report(spark, rows) == plain_report(rows)


def test_a_length_that_rules_likeness_out(spark):
    long = " ".join(f"the w{i} v{i}" for i in range(2000))
    rows = [(1, "the w1 v1"), (2, long), (3, "^ w0 v0")]
    assert report(spark, rows) == plain_report(rows)
    assert {r[0]: r[6] for r in report(spark, rows)} == {1: 0.0, 2: 0.0, 3: plain_likeness(plain_set("^ w0 v0"), plain_set("the w1 v1"))}


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    rel = con.sql(spotsigs.oracle_sql())
    df = spotsigs.fingerprint_report(spark.createDataFrame(ROWS, "doc_id long, text string"))
    assert rel.columns == df.columns
    assert sorted(rel.fetchall(), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_edits_are_near_and_neighbours_are_not(spark):
    rows = spotsigs.fingerprint_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_chars >= 400").collect()
    near = sorted(r.near_edited for r in rows)
    apart = sorted(r.near_next for r in rows)
    assert near[len(near) // 2] > 0.55 and near[len(near) // 20] > 0.33 and apart[-len(apart) // 20] < 0.1
