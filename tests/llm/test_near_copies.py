"""Near copies whose counts, edits or families hide what their shingle sets have in common."""

import numpy as np
import pytest

from lodestream.llm import near_copies
from lodestream.llm.near_copies import drop_near_copies
from test_pipeline import alike, plain_near, shingles

VOCABULARY = np.array([f"v{i}" for i in range(20_000)])


def words(rng, n):
    return rng.choice(VOCABULARY, n).tolist()


def stay(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_repeated_lines_neither_join_nor_part(spark):
    rng = np.random.default_rng(21)
    texts, want = [], set()
    for _ in range(20):
        # Unrelated texts that are mostly one repeated line are no copies of each other ...
        line = words(rng, 25)
        want |= {len(texts), len(texts) + 1}
        texts += [" ".join(words(rng, 90) + line * 9) for _ in range(2)]
    for _ in range(20):
        # ... and a text is a copy of itself, however often one of its lines is repeated.
        body, line = words(rng, 300), words(rng, 12)
        want.add(len(texts))
        texts += [" ".join(body + line), " ".join(body + line * 10)]
    assert stay(spark, texts) == want


def test_a_block_cut_off_or_put_in(spark):
    rng = np.random.default_rng(31)
    texts = []
    for i in range(200):
        body = words(rng, int(rng.integers(150, 600)))
        n, alike = len(body) - 4, rng.uniform(0.803, 0.85)
        if i % 2:
            copy = body[: int(np.ceil(alike * n)) + 4]
        else:
            copy = body[: n // 2] + words(rng, max(1, int((n - 4) / alike - n - 4))) + body[n // 2 :]
        texts += [" ".join(body), " ".join(copy)]
    assert stay(spark, texts) == set(range(0, 400, 2))



def changed(rng, body, n):
    out = list(body)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"x{rng.integers(1 << 60)}"
    return out


def family(rng, n):
    """2n texts of one template, alike (0.84) in pairs and otherwise not (0.6)."""
    template, texts = words(rng, 300), []
    for _ in range(n):
        one = changed(rng, template, 8)
        texts += [" ".join(one), " ".join(changed(rng, one, 5))]
    return texts


def test_copies_in_a_family_of_looser_variants(spark):
    assert stay(spark, family(np.random.default_rng(41), 300)) == set(range(0, 600, 2))


@pytest.mark.parametrize("block", [40, 300, near_copies.BLOCK])
def test_long_lists_of_members_alike_and_not(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    # Texts put together from two variants of each part, in pairs that differ in one: all their shingles
    # are in many texts, so copies meet in long lists only, with many that are none.
    rng = np.random.default_rng(51)
    parts, texts = [[words(rng, 20) for _ in range(2)] for _ in range(16)], []
    for _ in range(400):
        choice = rng.integers(2, size=16)
        other = choice.copy()
        other[rng.integers(16)] ^= 1
        texts += [" ".join(w for p, c in zip(parts, x) for w in p[c]) for x in (choice, other)]
    want = plain_near(list(enumerate(texts)))
    assert 300 < len(want) <= 400 and stay(spark, texts) == want


def plain_print(h):
    return sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))


def test_fingerprints_find_copies_by_the_index_and_the_exact_search_finds_the_rest(spark, monkeypatch):
    rng = np.random.default_rng(61)
    texts = []
    for i in range(60):  # close copies, and looser ones that fingerprints do not link
        body = words(rng, 400)
        texts += [" ".join(body), " ".join(changed(rng, body, 1 if i % 2 else 7))]
    line = words(rng, 25)
    texts += [" ".join(words(rng, 90) + line * 9) for _ in range(2)] + ["", "one two"]
    asked, kept = [], {}
    index, verify, unconnected = near_copies.candidate_links, near_copies.verified_links, near_copies._unconnected

    def recorded(nodes, bits, *more):
        asked.append((bits, {r.node for r in nodes.collect()}))
        return index(nodes, bits, *more)

    def with_false_ones(texts, distinct, candidates):
        # Links that fingerprints give by chance are held against the sets.
        nodes = distinct.selectExpr("node").orderBy("node")
        false = nodes.crossJoin(nodes.selectExpr("node AS v").limit(1)).selectExpr("node AS u", "v").where("u <> v") if "first" not in kept else candidates.limit(0)
        out = verify(texts, distinct, candidates.unionByName(false))
        kept.setdefault("first", out.collect())
        return out

    def left(candidates, links):
        out = unconnected(candidates, links)
        kept["links"], kept["rest"] = {(r.u, r.v) for r in links.collect()}, {(r.u, r.v) for r in out.collect()}
        return out

    for name, f in (("candidate_links", recorded), ("verified_links", with_false_ones), ("_unconnected", left)):
        monkeypatch.setattr(near_copies, name, f)
    want = plain_near(list(enumerate(texts)))
    assert stay(spark, texts) == want

    maps = near_copies.with_maps(near_copies._texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    of = {r.doc_id: (r.node, r.print) for r in maps.collect()}
    assert asked == [(4, {p for _, p in of.values()})]
    sets = near_copies.shingle_sets(*near_copies.text_bytes(near_copies.pa.array(texts)))
    h = np.split(sets[0], np.cumsum(sets[1])[:-1])
    assert [p & (1 << 64) - 1 for _, p in (of[i] for i in range(len(texts)))] == [plain_print(x) for x in h]
    prints = {}
    for i in range(len(texts)):
        for j in range(i):
            a, b = of[i], of[j]
            if bin((a[1] ^ b[1]) & (1 << 64) - 1).count("1") <= 4 and alike(shingles(texts[i]), shingles(texts[j])):
                prints[max(a[0], b[0]), min(a[0], b[0])] = 1
    least = min(node for node, _ in of.values())
    assert set(prints) <= kept["links"] and all(least in pair for pair in kept["links"] - set(prints)) and 10 <= len(prints) < 60
    assert not kept["rest"] & kept["links"] and len(want) == len(texts) - 60
