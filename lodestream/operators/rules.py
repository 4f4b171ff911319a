"""Rule classifiers: rules are data, compiled into one pass over each text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.tags import detect_entities
from lodestream.functions.text import blank

#: Edges of words of ASCII letters, digits and underscores; Java's own take other letters in, by version.
_EDGES = {"b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"}


@dataclass(frozen=True)
class Rule:
    """A text is hit if any of ``any_of`` is found in it and all of ``all_of`` are, in any case.

    ``\\b`` and ``\\B`` go by ASCII words, as ``\\w`` does.
    """

    rule_id: str
    any_of: tuple[str, ...]
    all_of: tuple[str, ...] = ()
    title: str = ""


def _by_ascii_words(pattern: str) -> str:
    return re.sub(r"\\(.)", lambda m: _EDGES.get(m[1], m[0]), pattern, flags=re.DOTALL)


def _hit(text: Column, rule: Rule) -> Column:
    found = text.rlike("(?iu)" + "|".join(f"(?:{_by_ascii_words(p)})" for p in rule.any_of)) if rule.any_of else F.lit(False)
    for p in rule.all_of:
        found = found & text.rlike(f"(?iu){_by_ascii_words(p)}")
    return found


def classify(text: Column, rules: Sequence[Rule]) -> Column:
    """Ids of the rules that hit, in rule order."""
    t = blank(text)
    hits = F.array(*[F.when(_hit(t, r), r.rule_id) for r in rules]) if rules else F.array().cast("array<string>")
    return F.filter(hits, lambda x: x.isNotNull())


def rule_table(df: DataFrame, rules: Sequence[Rule], family: str) -> DataFrame:
    """The rules as rows: (family, rule_id, ord, kind, pattern, title)."""
    rows = [(family, r.rule_id, i, kind, p, r.title) for i, r in enumerate(rules) for kind in ("any", "all") for p in getattr(r, f"{kind}_of")]
    return df.sparkSession.createDataFrame(rows, "family string, rule_id string, ord int, kind string, pattern string, title string")


def titles(ids: Column, rules: Sequence[Rule], separator: str = "、", none: str = "无") -> Column:
    table = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, r.title or r.rule_id)])
    return F.when(F.size(ids) == 0, none).otherwise(F.array_join(F.transform(ids, lambda i: F.coalesce(F.element_at(table, i), i)), separator))


def preferences(text: Column, rules: Sequence[Rule], aliases: dict[str, str], fallback: Column) -> tuple[Column, Column]:
    """(entities, topics); topics without an entity belong to all of ``fallback``."""
    found, topics = detect_entities(text, aliases), classify(text, rules)
    return F.when((F.size(found) == 0) & (F.size(topics) > 0), F.coalesce(fallback, F.array().cast("array<string>"))).otherwise(found), topics
