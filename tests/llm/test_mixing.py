import re
from collections import defaultdict

import numpy as np
import pytest

from lodestream.llm.mixing import BLOCK_WORDS, _dealt, mix_sources, mixing_report, sainte_lague

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_chars long, key int, size string, rank string"


def targets(sizes, weights, budget, max_repeats):
    """Shares of ``budget`` by weight, none above its cap, the excess reshared by weight."""
    caps = [max_repeats * n for n in sizes]
    out, free, left = [0.0] * len(caps), set(range(len(caps))), float(budget)
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total >= caps[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in sorted(over):
            out[i] = float(caps[i])
            left -= caps[i]
        free -= over
    return out


def plain_sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


@pytest.mark.parametrize("seed", range(20))
def test_seats_match_dealing_one_by_one(seed):
    rng = np.random.default_rng(seed)
    votes = [float(x) for x in rng.integers(0, 500, rng.integers(1, 12))]
    seats = int(rng.integers(0, 300))
    assert sainte_lague(votes, seats) == plain_sainte_lague(votes, seats)


def test_seats_over_a_table(spark):
    rng = np.random.default_rng(7)
    for votes, seats in (
        ([float(x) for x in rng.integers(0, 500, 40)], 333),
        ([5.0, 5.0, 5.0], 4),
        ([float(x) for x in rng.integers(1, 1 << 50, 300)], 10_000),
        ([16.0] * 50, 25),
        ([0.0, 0.0], 3),
        ([7.0], 3),
    ):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(votes)], "rank long, target double")
        got = [r.blocks for r in _dealt(df, seats).orderBy("rank").collect()]
        assert got == sainte_lague(votes, seats), (votes[:3], seats)


def test_many_sources(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 97 as int)) AS text", "concat('http://', id) AS source")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    out = mixing_report(df).collect()
    sizes = [r.source_size for r in sorted(out, key=lambda r: rows[r.doc_id][2])]
    goal = targets(sizes, [(3, 1, 2)[i % 3] for i in range(3000)], 1.5 * sum(sizes), 2)
    assert [r.target for r in sorted(out, key=lambda r: rows[r.doc_id][2])] == pytest.approx(goal)
    assert all(abs(r.taken - r.target) <= 4 * BLOCK_WORDS and r.taken <= 2 * r.size for r in out)


def test_seats_with_ties_and_nothing():
    assert sainte_lague([5.0, 5.0, 5.0], 4) == [2, 1, 1]
    assert sainte_lague([], 3) == [] and sainte_lague([0.0], 3) == [0]


def test_targets_stop_at_caps():
    t = targets([100, 100, 100, 0], [3, 1, 2, 3], 450, 2)
    assert t[3] == 0 and t[0] == 200 and sum(t) == pytest.approx(450)
    assert t[1] == pytest.approx(250 / 3) and t[2] == pytest.approx(500 / 3)


def check(rows, report):
    by_id = {r.doc_id: r for r in report}
    assert len(report) == len(rows)
    held, taken = defaultdict(int), defaultdict(int)
    for d, text, source in rows:
        r = by_id[d]
        assert r.size == len(WORD.findall(text or "")) and 0 <= r.taken <= 2 * r.size
        held[source] += r.size
        taken[source] += r.taken
    names = sorted((s for s in held if s is not None)) + ([None] if None in held else [])
    goal = targets([held[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(held.values()), 2)
    for s, t in zip(names, goal):
        assert abs(taken[s] - t) <= max(4 * BLOCK_WORDS, 0.01 * t), (s, taken[s], t)
    for d, _, source in rows:
        assert by_id[d].source_size == held[source]
        assert by_id[d].target == pytest.approx(goal[names.index(source)])


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    check(rows, mixing_report(df).collect())


def test_odd_rows_and_reruns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 900))), ["b", "a", None, "ab", "é"][int(rng.integers(5))]) for i in range(300)]
    rows += [(300, None, "a"), (301, "", "empty"), (302, " \t", None), (303, "x " * 30_000, "b")]
    df = spark.createDataFrame([(*r, 1, 2, "s", "t") for r in [(a, b, c) for a, b, c in rows]], SCHEMA)
    first = mixing_report(df).collect()
    check(rows, first)
    again = mixing_report(df.repartition(7, "n_chars", "text")).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))


def test_the_mix_holds_the_words_that_the_report_takes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing_report(df).collect()}
    mixed = mix_sources(df)
    assert mixed.columns == df.columns
    words = defaultdict(int)
    whole = {r.doc_id: r.text for r in df.collect()}
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and (r.text == whole[r.doc_id] or set(WORD.findall(r.text)) <= set(WORD.findall(whole[r.doc_id])))
    assert {d: n for d, n in taken.items() if n} == dict(words)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing_report(df).collect() == [] and mix_sources(df).collect() == []


def test_null_ids_and_repeats(spark):
    rows = [(None, "a b c d", "s", 1, 2, "s", "t")] * 3 + [(1, "a b", "s", 1, 2, "s", "t")] * 2
    assert len(mixing_report(spark.createDataFrame(rows, SCHEMA)).collect()) == 5
