"""Overlap of short texts by character pairs, and what counts as said, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.scan import let
from lodestream.functions.text import blank, squash, strip

#: Marks of questions, where clauses end, and replies that say nothing.
QUESTION_HINTS = ("还是", "吗", "呢", "哪", "什么", "多少", "几")
CLAUSE_END = r"[。！？!?；;]+"
BACKCHANNEL = r"^(嗯+|啊+|哦+|呃+|好的?|是的?|对)$"
COMMAND_PREFIX = "请求主动询问"
QUESTION_COVERAGE, UTTERANCE_COVERAGE = 0.32, 0.50


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, white space left out; a single character is itself."""

    def paired(chars: Column) -> Column:
        pairs = F.transform(F.slice(chars, F.lit(1), F.size(chars) - 1), lambda c, i: F.concat(c, F.get(chars, i + 1)))
        return F.when(F.size(chars) <= 1, chars).otherwise(F.array_distinct(pairs))

    return let(F.regexp_extract_all(squash(blank(text), ""), F.lit("(?s)."), F.lit(0)), paired)


def coverage(a: Column, b: Column) -> Column:
    """Of two sets, the part of the smaller one that the other holds."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def jaccard(a: Column, b: Column) -> Column:
    empty = (F.size(a) <= 0) | (F.size(b) <= 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def clause_cores(text: Column, hints: tuple[str, ...] = QUESTION_HINTS, least: int = 4) -> Column:
    """The text and those of its clauses that look like questions."""
    bare = strip(blank(text))
    clauses = F.transform(F.split(bare, CLAUSE_END), lambda c: F.regexp_replace(c, r"^[ ，,]+|[ ，,]+\z", ""))
    asked = F.filter(clauses, lambda c: (F.length(c) >= least) & c.rlike("|".join(hints)))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(bare), asked))


def core_sets(text: Column) -> Column:
    """The character pairs of each of a text's clause cores: made once a text, before any two texts meet."""
    return F.transform(clause_cores(text), bigrams)


def sets_cover(left: Column, right: Column) -> Column:
    """The greatest coverage of any two of the sets of two texts; 0 where a text has none."""
    pairs = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: coverage(a, b))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def max_coverage(left: Column, right: Column) -> Column:
    return let(core_sets(left), lambda a: let(core_sets(right), lambda b: sets_cover(a, b)))


def repeats_known(text: Column, asks: Column, utterances: Column, ask_limit: float = QUESTION_COVERAGE, said_limit: float = UTTERANCE_COVERAGE) -> Column:
    """Whether a text asks again what was asked, or repeats what the visitor said."""

    def near(sets: Column, known: Column, limit: float) -> Column:
        return F.exists(known, lambda k: let(core_sets(k), lambda b: sets_cover(sets, b)) >= limit)

    return let(core_sets(text), lambda sets: (F.size(sets) > 0) & (near(sets, asks, ask_limit) | near(sets, utterances, said_limit)))


def is_command(query: Column, prefix: str = COMMAND_PREFIX) -> Column:
    return strip(blank(query)).startswith(prefix)


def is_recordable(query: Column, prefix: str = COMMAND_PREFIX, backchannel: str = BACKCHANNEL) -> Column:
    bare = strip(blank(query))
    return (F.length(bare) >= 2) & ~is_command(query, prefix) & ~bare.rlike(backchannel)


def asked_texts(pairs: Column) -> Column:
    return F.filter(F.transform(pairs, lambda p: strip(blank(p["ask"]))), lambda a: a != "")


def starts_with_intent(reply: Column, tag: str) -> Column:
    return blank(reply).rlike(rf"(?is)^\s*<INTENT>\s*\Q{tag}\E\s*</INTENT>")
