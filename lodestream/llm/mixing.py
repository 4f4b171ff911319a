"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix has a budget of words. Sources get targets by weight, capped at ``max_repeats`` times what
they hold, the excess reshared. The budget is cut into equal blocks of words; blocks go to sources
by highest quotients target / (2 q + 1), and each source's blocks to its shards by highest quotients
of shard sizes, so every shard has a whole quota. A shard is its documents in seeded order, read as
one run of words cut into blocks; a quota of q out of n blocks takes all of them q div n times, and
q mod n of them once more, chosen from a seeded start at even steps over that order.

Only (doc_id, source, size) rows are shuffled for the plan. Sources are split into up to
``MAX_SHARDS`` shards of about ``SHARD_WORDS`` words, so a hot source is spread. Sources stay a table: the
level to which targets rise and the divisor that deals out the blocks are found by sums over it, so the
driver gets a few numbers, however many sources there are.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source
of its own, after all others; a null doc_id is a value like any other; equal rows are placed one
after the other; an empty table gives an empty result; the same rows give the same result whatever
their order or partitioning.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.text import WORD, word_count
from lodestream.storage import materialize

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 16
SHARD_WORDS = 20_000
MAX_SHARDS = 4096
#: Sources beyond this many are joined by a shuffle, not broadcast.
MAX_BROADCAST_SOURCES = 100_000
#: Divisors tried at a time.
DIVISORS = 32
SEED = 17


def sainte_lague(votes: Sequence[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 q + 1); ties go to the earlier party.

    A divisor found by bisection gives all seats but the last few at once; those are dealt singly.
    """
    v = np.asarray(votes, dtype=float)
    if seats <= 0 or not len(v) or v.sum() <= 0:
        return [0] * len(v)
    low, high = 0.0, float(v.max()) * 2 + 1
    for _ in range(200):
        mid = (low + high) / 2
        if np.floor(v / mid + 0.5).sum() <= seats:
            high = mid
        else:
            low = mid
    won = np.floor(v / high + 0.5).astype(int)
    queue = [(-x / (2 * q + 1), i) for i, (x, q) in enumerate(zip(v.tolist(), won.tolist(), strict=True)) if x > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(won.sum())):
        _, i = heapq.heappop(queue)
        won[i] += 1
        heapq.heappush(queue, (-v[i] / (2 * won[i] + 1), i))
    return won.tolist()


def _ranked(rows: DataFrame) -> DataFrame:
    """(source, source_size, rank): sources by code point, null last, numbered along a sort."""
    held = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    held = held.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id())
    held = materialize(held.withColumn("part", F.expr("shiftright(at, 33)")), "mix-held")
    begin, first = 0, []
    for r in sorted(held.groupBy("part").count().collect()):  # one for each partition of the sort
        first.append((r["part"], begin))
        begin += r["count"]
    first = F.broadcast(rows.sparkSession.createDataFrame(first, "part long, first long"))
    return held.join(first, "part").select("source", "source_size", (F.col("first") + F.expr("at & 8589934591L")).alias("rank"))


def _level(sources: DataFrame, budget: float) -> float | None:
    """How much a weight of one gets where no cap is in the way; none if all caps are reached.

    The excess of capped sources lifts the level for others until none is above its cap.
    """
    level, n_over = 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * level
        n, caps, weights = sources.agg(
            F.sum(over.cast("long")), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        if not weights:
            return None
        if n == n_over:
            return level
        n_over, level = n, (budget - caps) / weights


def _dealt(sources: DataFrame, seats: int) -> DataFrame:
    """Adds blocks, by highest quotients target / (2 q + 1): Sainte-Lague over a table.

    A divisor that deals out no more than the seats is found by sums for some divisors at a time; what is
    then left goes to the next highest quotients, ties to the lesser rank.
    """

    def won(divisor: float) -> Column:
        return F.floor(F.col("target") / divisor + 0.5)

    most = sources.agg(F.max("target")).first()[0] or 0.0
    if seats <= 0 or most <= 0:
        return sources.withColumn("blocks", F.lit(0).cast("long"))
    low, high, given = 0.0, 2 * most + 1, 0
    while given < seats and high - low > 1e-12 * high:
        start = max(low, high / 2**DIVISORS)
        tried = [start + (high - start) * k / (DIVISORS + 1) for k in range(1, DIVISORS + 1)]
        sums = list(sources.agg(*[F.sum(won(x)) for x in tried]).first())
        fits = [k for k, n in enumerate(sums) if n <= seats]
        if fits:
            high, given = tried[fits[0]], sums[fits[0]]
            low = tried[fits[0] - 1] if fits[0] else start
        else:
            low = tried[-1]
    dealt = sources.withColumn("blocks", won(high).cast("long"))
    if given == seats:
        return dealt
    following = (F.col("target") / (2 * F.col("blocks") + 1)).desc()
    last = dealt.where("target > 0").orderBy(following, "rank").limit(int(seats - given)).select(F.col("rank").alias("lucky"))
    dealt = dealt.join(last, F.col("rank") == F.col("lucky"), "left")
    return dealt.withColumn("blocks", F.col("blocks") + F.col("lucky").isNotNull().cast("long")).drop("lucky")


def _sources(rows: DataFrame) -> DataFrame:
    """(source, rank, source_size, target, blocks, shards)."""
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    sources = _ranked(rows).withColumns(
        {"weight": F.get(weights, (F.col("rank") % len(WEIGHTS)).cast("int")), "cap": (MAX_REPEATS * F.col("source_size")).cast("double")}
    )
    sources = materialize(sources, "mix-ranked")
    level = _level(sources, BUDGET * (sources.agg(F.sum("source_size")).first()[0] or 0))
    goal = F.col("cap") if level is None else F.least("cap", F.col("weight") * level)
    sources = materialize(sources.withColumn("target", goal), "mix-targets")
    dealt = _dealt(sources, round((sources.agg(F.sum("target")).first()[0] or 0.0) / BLOCK_WORDS))
    shards = F.expr(f"CAST(greatest(1, least({MAX_SHARDS}, ceil(source_size / {SHARD_WORDS}))) AS INT)")
    return materialize(dealt.select("source", "rank", "source_size", "target", "blocks", shards.alias("shards")), "mix-sources")


def _plan(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """For rows with source and size: per source (rank, target, shards), per shard its quota."""
    sources = _sources(rows)
    placed = _place(rows, sources, sources.count(), seed)

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        n = -(-pdf["words"] // BLOCK_WORDS)
        won = np.minimum(sainte_lague(pdf["words"].tolist(), int(pdf["blocks"].iloc[0])), MAX_REPEATS * n)
        return pdf.assign(n=n, quota=won)[["rank", "shard", "n", "quota"]]

    shard_words = placed.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    quota = shard_words.groupBy("rank").applyInPandas(quotas, "rank long, shard long, n long, quota long")
    return sources, materialize(quota, "mix-quotas")


def _place(rows: DataFrame, sources: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """Adds rank, shard and a seeded sort key to each row."""
    side = sources.withColumnRenamed("source", "source_name")
    side = F.broadcast(side) if n_sources <= MAX_BROADCAST_SOURCES else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("source_name"))).withColumns(
        {
            "shard": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("shards").cast("long")),
            "key": F.xxhash64(F.lit(seed + 1), "doc_id", "size"),
        }
    )


def _taken_before(word: str) -> str:
    """SQL for how many of a shard's words before ``word`` lie in blocks chosen once more."""
    j = f"({word} div {BLOCK_WORDS})"
    before = f"(({j} * extra + start) div n)"
    after = f"((({j} + 1) * extra + start) div n)"
    return f"{BLOCK_WORDS} * {before} + ({word} % {BLOCK_WORDS}) * ({after} - {before})"


def _allot(rows: DataFrame, seed: int) -> DataFrame:
    """Adds source_size, target, begin (its first word's place in the shard), whole, extra, start, n, more."""
    sources, quota = _plan(rows, seed)
    placed = _place(rows, sources, sources.count(), seed)
    order = Window.partitionBy("rank", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("end", F.sum("size").over(order))
        .join(quota, ["rank", "shard"])
        .withColumns(
            {
                "begin": F.col("end") - F.col("size"),
                "whole": F.when(F.col("n") > 0, F.expr("quota div n")).otherwise(0).cast("long"),
                "extra": F.when(F.col("n") > 0, F.expr("quota % n")).otherwise(0).cast("long"),
                "start": F.when(F.col("n") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "shard"), F.col("n"))).otherwise(0),
                "n": F.greatest("n", F.lit(1)),
            }
        )
        .withColumn("more", F.expr(f"({_taken_before('end')}) - ({_taken_before('begin')})"))
    )


def mixing_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken."""
    rows = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    return _allot(rows, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).alias("taken")
    )


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``.

    A document comes whole as often as its shard repeats, and once more with the words of the
    blocks chosen from it, joined by single spaces; n_chars follows the text.
    """
    rows = docs.select(
        F.struct("*").alias("row"), "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")
    )
    allotted = _allot(rows, seed)
    chosen = (
        f"filter(regexp_extract_all(row.text, '{WORD.replace(chr(92), chr(92) * 2)}', 0), (w, i) -> "
        f"((((begin + i) div {BLOCK_WORDS}) + 1) * extra + start) div n > (((begin + i) div {BLOCK_WORDS}) * extra + start) div n)"
    )
    part = F.array_join(F.expr(chosen), " ")
    row = F.col("row")
    shorter = row.withField("text", F.col("part"))
    if "n_chars" in docs.columns:
        shorter = shorter.withField("n_chars", F.length("part").cast(docs.schema["n_chars"].dataType))
    whole = F.array_repeat(row, F.col("whole").cast("int"))
    once = allotted.where("size > 0").withColumn("part", F.when(F.col("more") == F.col("size"), row["text"]).when(F.col("more") > 0, part))
    parts = F.when(F.col("more") > 0, F.array(shorter)).otherwise(F.slice(F.array(row), 1, 0))
    return once.select(F.explode(F.concat(whole, parts)).alias("row")).select("row.*")
