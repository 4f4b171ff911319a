"""Chat formatting with cumulative-snapshot collapse. DataFrame functions only.

A log often holds a conversation again each time it grows. Each conversation gets a rolling hash
over its turns; one whose full hash is the hash of a proper prefix of a longer conversation is a
snapshot of it and goes. Equal conversations collapse into the one with the smallest conv_id. What
remains is maximal and is rendered.

Defined results: null roles and texts count as empty; a row with a null conv_id is a
conversation of its own, of one turn; turns are ordered by (turn, role, text), nulls first, and rows equal in all of them count
once; an empty table gives an empty result; further columns are ignored. A conversation becomes
one row, so the longest conversation, not the number of its copies, bounds the memory of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.scan import running
from lodestream.llm.text import text_or_empty

START, END = "<|im_start|>", "<|im_end|>"


def _role(role: Column) -> Column:
    return F.lower(F.trim(text_or_empty(role)))


def _escape(text: Column) -> Column:
    """A marker written in a text is broken by a space, so that only the rendering makes turns."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def gather(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order."""
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        _role(F.col("role")).alias("role"),
        text_or_empty(F.col("text")).alias("text"),
    )
    # Rows that belong to no conversation are told apart by what they hold, so they do not meet in one task.
    alone = F.sha2(F.concat_ws(":", F.col("turn").cast("string"), F.length("x.role").cast("string"), "x.role", "x.text").cast("binary"), 256)
    rows = conversations.select("conv_id", "turn", turn.alias("x")).withColumn("alone", F.when(F.col("conv_id").isNull(), alone))
    return rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_set("x")).alias("turns")).drop("alone")


def rolling_hashes(turns: Column) -> Column:
    """Array of (n, a, b): the i-th covers turns 0 to i, n is their number.

    Each turn is hashed twice with its place, and hashes roll on by exclusive or; two of 64 bits and the
    number of turns stand for a prefix.
    """

    def lane(seed: int) -> Column:
        own = F.transform(turns, lambda t, i: F.xxhash64(F.lit(seed), i, t["role"], t["text"]))
        return running(own, lambda x, y: x.bitwiseXOR(y), F.lit(0).cast("long"))

    both = F.zip_with(lane(1), lane(2), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.transform(both, lambda h, i: F.struct((i + 1).alias("n"), h["a"].alias("a"), h["b"].alias("b")))


def render(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(START), _escape(t["role"]), F.lit("\n"), _escape(t["text"]), F.lit(END))), "\n"
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, n_copies) of the conversations that prefix no longer one."""
    hashed = gather(conversations).withColumn("hashes", rolling_hashes(F.col("turns")))
    whole = (
        hashed.withColumn("full", F.element_at("hashes", -1))
        .groupBy("full")
        .agg(
            F.min_by("turns", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("turns"),
            F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first"),
            F.count("*").alias("n_copies"),
        )
    )
    prefixes = hashed.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("full")).distinct()
    return whole.join(prefixes, "full", "left_anti").select(F.col("first.conv_id").alias("conv_id"), "turns", "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: one row for each maximal conversation."""
    return maximal_conversations(conversations).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", render(F.col("turns")).alias("rendered")
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS turns
  FROM (SELECT DISTINCT conv_id, turn, lower(trim(coalesce(role, ''))) AS role, coalesce(text, '') AS text
        FROM conversations)
  GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN {'turn': turn, 'role': role, 'text': text} END
), k AS (
  SELECT conv_id, turns, list_transform(turns, lambda t: [t.role, t.text]) AS body FROM c
), w AS (
  SELECT body, min(conv_id) AS conv_id, count(*) AS n_copies FROM k GROUP BY body
), p AS (
  SELECT DISTINCT body[1:n] AS body FROM (SELECT body, unnest(range(1, len(body))) AS n FROM k)
)
SELECT conv_id, CAST(len(body) AS BIGINT) AS n_turns, n_copies,
       array_to_string(list_transform(body, lambda b: '<|im_start|>' || replace(b[1], '<|', '< |') || chr(10)
         || replace(b[2], '<|', '< |') || '<|im_end|>'), chr(10)) AS rendered
FROM w ANTI JOIN p USING (body)
"""
