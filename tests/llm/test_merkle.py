"""The Merkle manifest against a plain one."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lodestream.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, root string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The root, and for each leaf its siblings (left, right) from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
            paths[i].append((run[: k % 3], run[k % 3 + 1 :]))
        at = [k // 3 for k in at]
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    if not rows:
        return []
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *plain_tree([leaf(r) for r in own]))
    root, tops = plain_tree([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            way = path + top
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf((*r[:4], text))
            for left, right in way:
                node = h("".join(left) + node + "".join(right))
            proof = h("".join(x for left, right in way for x in left + right))
            out.append((r[0], leaf(r), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def report(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)
    out = merkle.manifest_report(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10, 28, 100])
def test_one_source_of_any_size(spark, n):
    rows = [(i * 7, "s", "en", i, f"line {i}\nnext") for i in range(n)]
    assert report(spark, rows) == plain_manifest(rows)


def test_many_sources_and_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (2, None, "en", 1, ""), (None, "b", "en", 3, "a\nb"), (None, "b", "en", 3, "a\nb"), (4, "b", "en", 3, "a\nb"), (4, "b", "en", 3, "a\nb"),
        (4, "b", "en", 3, "other\n"), (5, "", "de", 2, "\n"), (6, "é", "fr", 2, "\n\n"), (7, "Z", None, 9, "é😀\n"), (8, "lone", "en", 40_000, "x\n" * 40_000), (-3, "b", "en", 0, "-\n"),
    ]
    rows += [(100 + i, f"src{i % 11}", "en", i, f"t{i}\n") for i in range(60)] + [(1000 + i, "hot", "en", i, f"t{i}\n" * (i % 3)) for i in range(250)]
    got, want = report(spark, rows, 7), plain_manifest(rows)
    # Equal rows change places freely: they have the same leaf, and their proofs as a set are the same.
    assert got == want
    assert {r[6] for r in got} == {True, False} and len({r[3] for r in got}) == 1


def test_a_run_of_equal_rows(spark):
    rows = [(1, "s", "en", 1, "same\n")] * 200 + [(2, "s", "en", 1, "last")]
    assert report(spark, rows, 5) == plain_manifest(rows)


def test_no_text_is_shuffled_and_levels_are_kept_apart(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "concat('text ', id) AS text")
    rows = docs.select("doc_id", "source", merkle.leaf_digest(*[F.col(c) for c in merkle.FIELDS]).alias("leaf"), F.lit(None).cast("string").alias("carried"))
    got = merkle.manifest(rows)
    assert got.count() == 200 and "text" not in got.columns
    leaves = rows.selectExpr("'=s' AS tree", "doc_id AS pos", "200L AS size", "leaf AS digest")
    store = merkle.build(leaves)
    assert [store.level(k).count() for k in range(1, store.height + 1)] == [67, 23, 8, 3, 1]
    assert store.subroots(leaves).first()["digest"] == got.first()["subroot"]


def test_on_the_supplied_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    assert sorted(map(tuple, merkle.manifest_report(docs).collect()), key=repr) == plain_manifest(rows)
