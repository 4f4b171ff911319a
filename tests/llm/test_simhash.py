import re

import numpy as np
import xxhash

from lodestream.llm.simhash import candidate_links, covering_triples, forest, simhash_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, fp string, key int"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_report(rows):
    ids, prints = [r[0] for r in rows], np.array([plain_fingerprint(r[1]) for r in rows], dtype=np.uint64)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4).tolist():
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted([(ids[i], f"{int(prints[i]):016x}", least[root(i)]) for i in range(len(rows))], key=repr)


def got(df):
    return sorted([(r.doc_id, r.fingerprint, r.component_id) for r in simhash_report(df).collect()], key=repr)


def test_triples_cover_every_four_positions():
    from itertools import combinations

    assert len(covering_triples()) == 20
    assert all(any(set(t) <= set(q) for t in covering_triples()) for q in combinations(range(8), 4))


def test_odd_rows(spark):
    rows = [
        (1, "a b c d e f"), (2, "A  b\tc d\ne f"), (3, None), (4, ""), (5, " \n "), (6, "one"), (7, "ONE"), (8, "Éa b c"),
        (9, "éa b c"), (None, "a b c d e f"), (None, "x y z w"), (1, "a b c d e f"), (10, "w " * 50_000), (11, "a b c d e"),
    ]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)
    assert got(df) == plain_report(rows)


def test_dense_groups_and_chains_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(3):
        body = rng.choice(words, 120).tolist()
        for i in range(90):
            new = list(body)
            for _ in range(i % 4):
                new[int(rng.integers(len(new)))] = str(rng.choice(words))
            rows.append((base * 1000 + i, " ".join(new)))
    assert got(spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)) == plain_report(rows)


def test_empty_table(spark):
    assert simhash_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents_match_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(df) == plain_report(rows)


def test_forest_keeps_components():
    u, v = forest(np.array([5, 9, 3, 7]), np.array([3, 5, 2, 8]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(3, 2), (5, 2), (8, 7), (9, 2)]


def test_split_lists_lose_no_link(spark):
    # A dense ball, a sparse crowd that shares three bytes, and strays: the same components at any limit.
    rng = np.random.default_rng(6)
    ball = np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(64, size=200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(64, size=200).astype(np.uint64))
    crowd = rng.integers(1 << 40, size=300).astype(np.uint64) | np.uint64(0x777777 << 40)
    near = crowd[:100] ^ (np.uint64(15) << rng.integers(36, size=100).astype(np.uint64))
    prints = np.unique(np.concatenate([ball, crowd, near, rng.integers(1 << 63, size=100).astype(np.uint64)]))
    i, j = np.triu_indices(len(prints), 1)
    hit = np.bitwise_count(prints[i] ^ prints[j]) <= 4
    signed = prints.view(np.int64)
    want = sorted(zip(*(x.tolist() for x in forest(signed[i[hit]], signed[j[hit]]))))
    nodes = spark.createDataFrame([(int(x),) for x in signed], "node long")
    for limit in (10, 100_000):
        links = candidate_links(nodes, 4, limit).toPandas()
        assert sorted(zip(*(x.tolist() for x in forest(links.u.to_numpy(), links.v.to_numpy())))) == want
