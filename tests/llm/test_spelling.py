"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lodestream.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, form string, key long"


def plain_counts(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        if vs:
            best = min(vs, key=lambda v: (-counts[v], v))
            if counts[best] >= 2 * counts[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), counts[w], len(near[w]), counts.get(form.get(w))) for w in counts), key=repr)


def report(spark, rows):
    out = spelling.variant_report(spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in rows], SCHEMA).repartition(3))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, out.collect()), key=repr)


def texts(seed, words, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]


def test_edits_chains_and_ties(spark):
    chain = ["straight"] * 40 + ["straght"] * 20 + ["straghtt"] * 8 + ["straghtta"] * 4 + ["straghttab"] * 3
    ties = ["colour"] * 6 + ["coloura"] * 6 + ["colours"] * 3 + ["zolour"] * 3 + ["color"] * 12
    letters = ["aaaaa"] * 9 + ["aaaaaa"] * 4 + ["aaaaab"] * 3 + ["baaaaa"] * 3 + ["Éaaaaa"] * 3 + ["éaaaaa"] * 3 + ["aaaÿaa"] * 3
    rows = [(i, w) for i, w in enumerate(chain + ties + letters)]
    rows += [(None, "nullid nullid nullid"), (None, "nullid"), (7, None), (8, ""), (9, "abcde-abcde-abcde_ABCDE"), (9, "abcde"), (9, "abcde"), (10, "x×yzzz " * 4)]
    got = report(spark, rows)
    assert got == plain_variants(plain_counts(rows))
    assert len({r[2] for r in got}) < len(got)
    assert report(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_words_with_damage(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé", k=rng.randint(5, 9))) for _ in range(150)]
    rows = texts(seed, base + base[:20] * 8, 400)
    counts = plain_counts(rows)
    assert report(spark, rows) == plain_variants(counts)


def test_long_words(spark):
    rng = random.Random(3)
    rows = []
    for size in (62, 63, 64, 65, 66, 300, 3000):
        w = "".join(rng.choices("abcdefgh", k=size))
        many = [w] * 12 + [w[:-1] + "z"] * 4 + [w[1:]] * 3 + [w + "b"] * 3 + [w[:5] + "y" + w[6:]] * 3 + [w[: size // 2] + w[size // 2 + 2 :]] * 3
        rows += [(1000 * size + i, x) for i, x in enumerate(many)]
    assert report(spark, rows) == plain_variants(plain_counts(rows))


def test_keys_are_those_of_the_rests():
    for words in (["straight", "strength"], ["q" * 70, "abcde" * 14]):
        keys, check = spelling.deletion_keys(words)
        for w, row, c in zip(words, keys, check):
            for i in range(len(w)):
                rest = w[:i] + w[i + 1 :]
                k, d = spelling.deletion_keys([rest])
                assert row[i] == k[0, -1] and (len(rest) < spelling.LONG or c[i] == d[0, -1])
        assert len(np.unique(spelling.deletion_keys(["abcdefghij"])[0])) == 11


def test_keys_that_collide_do_not_join_words():
    words = ["straight", "straigth", "staircase", "strraight"]
    rows = [(7, 0, p, i, 10 - i, w) for i, w in enumerate(words) for p in (*range(len(w)), -1)]
    got = spelling.near_in_bucket(pd.DataFrame(rows, columns=["key", "check", "place", "word_no", "n", "word"]))
    assert sorted(map(tuple, got.itertuples(index=False))) == [(0, 1, 7, 3), (3, 1, 10, 0)]


def test_on_the_supplied_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert report(spark, rows) == plain_variants(plain_counts(rows))
