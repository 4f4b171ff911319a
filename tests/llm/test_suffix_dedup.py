import hashlib

import numpy as np
import pytest

from lodestream.llm import suffix_dedup
from lodestream.llm.suffix_dedup import repeated_spans

SCHEMA = "doc_id long, text string, part int, kind string, key string"


def plain(rows):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        gone = gone[: len(b)]
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in repeated_spans(df).collect()], key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1, "x", "y") for a, b in rows], SCHEMA)


def planted(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé "), int(rng.integers(1, 9)))) for _ in range(200)]
    body = lambda k: " ".join(rng.choice(words, k))
    shared = [body(int(k)) for k in rng.integers(10, 120, 6)]
    rows = []
    for i in range(n):
        parts = [body(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(len(shared)))]
            a = int(rng.integers(0, len(s)))
            parts += [s[a : a + int(rng.integers(1, 400))], body(int(rng.integers(0, 20)))]
        rows.append((int(i), "".join(parts)))
    rows += [(n, "ab" * 300), (n + 1, "Er " * 200 + "x" + "Er " * 90), (n + 2, rows[3][1]), (n + 3, "z" * 100), (n + 4, "z" * 101), (n + 5, "z" * 99)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rows = planted(seed)
    assert got(frame(spark, rows)) == plain(rows)


def test_buckets_of_many_kinds(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY_KINDS", 1)
    rows = planted(9)
    assert got(frame(spark, rows)) == plain(rows)


def test_runs_hold_each_suffix_once_whatever_the_pieces(monkeypatch):
    texts = [t.encode() for _, t in planted(4, 20)]
    buf, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    want = sorted((d, p) for d, t in enumerate(texts) for p in range(len(t) - 99))
    for piece in (97, 1000, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        doc, place, size, _, _ = suffix_dedup.cut_runs(buf, offsets)
        assert size.max() <= suffix_dedup.PLACES
        held = sorted((d, p + k) for d, p, n in zip(doc.tolist(), place.tolist(), size.tolist()) for k in range(n))
        assert held == want


def test_odd_rows(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(400))
    rows = [(1, None), (2, ""), (3, long), (4, long[50:220]), (5, "é" * 60), (6, "é" * 50)]
    assert got(frame(spark, rows)) == plain(rows)
    assert got(frame(spark, [])) == []
    same = [(7, long), (7, long), (None, long), (None, "short"), (8, "q" + long)]
    result = got(frame(spark, same))
    assert sorted(r[2] for r in result) == [0, 377, 400, 400, 400]  # the first is periodic, too


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(df) == plain([(r.doc_id, r.text) for r in df.collect()])
