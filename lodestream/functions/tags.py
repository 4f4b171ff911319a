"""Query clean-up and tag resolution as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.text import blank, strip

#: What a spoken query may begin with, and what may follow it.
FILLERS = ("嗯嗯", "呃呃", "嗯呐", "嗯啊", "嗯", "呃", "额", "啊", "哦", "噢", "唔", "唉", "嘿", "诶", "欸")
FILLER_TRAIL = "，。、！？,.!?;；…·—-~～、 \t\r\n　"
GENERAL, RESERVED = "general", "active_ask"


def _quoted(words: Sequence[str]) -> str:
    return "|".join(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", w) for w in words)


def strip_fillers(query: Column, fillers: Sequence[str] = FILLERS, trail: str = FILLER_TRAIL) -> Column:
    """Leading fillers with what trails them; a query of nothing else stays."""
    bare = strip(blank(query))
    inside = re.sub(r"([\\\]\[^-])", r"\\\1", trail)
    left = F.regexp_replace(bare, rf"^(?:(?:{_quoted(fillers)})[{inside}]*)+", "")
    return F.when(bare == "", blank(query)).when(left == "", bare).otherwise(left)


def merge_tags(*lists: Column) -> Column:
    """One list, lower case, first occurrences."""
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_distinct(F.filter(F.transform(every, lambda t: F.lower(strip(blank(t)))), lambda t: t != ""))


def place_tags(tags: Column, greeting: str | None = None) -> Column:
    """Tags that name a place or entity: neither general, reserved nor the greeting place."""
    norm = F.filter(F.transform(tags, lambda t: F.lower(strip(blank(t)))), lambda t: t != "")
    return F.filter(norm, lambda t: (t != GENERAL) & ~t.startswith(RESERVED) & (t != (greeting or "")))


def single_place(active: Column, location: Column, greeting: str | None = None) -> Column:
    both = F.array_distinct(F.concat(place_tags(active, greeting), place_tags(location, greeting)))
    return F.when(F.size(both) == 1, F.get(both, F.lit(0)))


def prefix_names(query: Column, tags: Column, names: Column) -> Column:
    """Display names of the known tags before the query."""
    text = strip(blank(query))
    shown = F.filter(F.transform(place_tags(merge_tags(tags)), lambda t: F.element_at(names, t)), lambda n: n.isNotNull() & (n != ""))
    return F.when((text == "") | (F.size(shown) == 0), text).otherwise(F.concat(F.array_join(shown, "，"), F.lit("，"), text))


def detect_tags(query: Column, known: Sequence[str]) -> Column:
    """Known tags that stand alone in the query, any case, in the order of ``known`` by length."""
    ordered = sorted(dict.fromkeys(known), key=lambda t: (-len(t), t))
    if not ordered:
        return F.array().cast("array<string>")
    found = F.transform(
        F.regexp_extract_all(blank(query), F.lit(rf"(?i)(?<![a-zA-Z0-9])({_quoted(ordered)})(?![a-zA-Z0-9])"), F.lit(1)), F.lower
    )
    return F.filter(F.array(*[F.lit(t) for t in ordered]), lambda t: F.array_contains(found, t))


def detect_entities(text: Column, aliases: dict[str, str]) -> Column:
    """Entities by alias, in order of first mention."""
    ordered = sorted(aliases, key=lambda a: (-len(a), a))
    mentions = F.regexp_extract_all(blank(text), F.lit(rf"(?i)(?<![a-zA-Z0-9])({_quoted(ordered)})(?![a-zA-Z0-9])"), F.lit(1))
    table = F.create_map(*[F.lit(x) for a in ordered for x in (a.lower().replace(" ", ""), aliases[a])])
    return F.array_distinct(F.transform(mentions, lambda m: F.element_at(table, F.replace(F.lower(m), F.lit(" "), F.lit("")))))


def has_visit_intent(query: Column, keywords: Sequence[str]) -> Column:
    return strip(blank(query)).rlike(_quoted(keywords))


def visit_locations(query: Column, locations: Column) -> Column:
    return F.filter(locations, lambda x: (x != "") & F.contains(blank(query), x))


def navigation_tags(query: Column, keywords: Sequence[str], locations: Column, default: str) -> Column:
    """Null without visit intent; else the places named, or the default one."""
    named = F.transform(visit_locations(query, locations), lambda x: F.lower(strip(x)))
    return F.when(has_visit_intent(query, keywords), F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(default))))


def pose(query: Column) -> Column:
    """The place a command says is near, if it is one."""
    tag = F.lower(F.regexp_extract(blank(query), r"(?i)(?:^|\s)nearby_pose=([A-Za-z0-9_\-]+)", 1))
    return F.when((tag != "") & (tag != GENERAL) & ~tag.startswith(RESERVED), tag)


def split_user(text: Column) -> tuple[Column, Column]:
    """(query, user) of text that ends in `` --user``; unsplit if nothing follows."""
    user = strip(F.substring_index(text, " --", -1))
    has = F.contains(text, F.lit(" --")) & (user != "")
    query = F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, " --", -1)) - 3)
    return F.when(has, strip(query)).otherwise(strip(text)), F.when(has, user)


def utterance_hint(utterances: Column, limit: int = 4, before: str = "顾客已说 ", after: str = " 不要再问已经说过的内容") -> Column:
    said = F.filter(F.transform(utterances, strip), lambda u: u != "")
    last = F.slice(said, F.greatest(F.size(said) - limit + 1, F.lit(1)), limit)
    return F.when(F.size(said) <= 0, "").otherwise(F.concat(F.lit(before), F.array_join(last, " "), F.lit(after)))


#: Phrases of the retrieval query for a stage.
PHRASES = {
    "pose": ("当前在", "展车旁 开口话术"),
    "entities": "顾客关注 ",
    "topics": "已问过 ",
    "go_on": "围绕已问过的点继续 不要编造没问过的卖点",
    "nothing": "尚无明确关注点 不要点名具体卖点 轻轻探问来意或下一环节",
}


def stage_query(template: Column, place: Column, utterances: Column, entities: Column, topics: Column, extra: Column, names: Column, hints: Column) -> Column:
    """The retrieval query for a stage: its template and what is known of the visitor."""
    from lodestream.functions.text import display_name

    hint, some_topics = utterance_hint(utterances), F.slice(topics, 1, 4)
    parts = [
        strip(blank(template)),
        F.when(blank(place) != "", F.concat(F.lit(PHRASES["pose"][0]), display_name(place, names), F.lit(PHRASES["pose"][1]))),
        hint,
        F.when(F.size(entities) > 0, F.concat(F.lit(PHRASES["entities"]), F.array_join(F.transform(F.slice(entities, 1, 3), lambda e: display_name(e, names)), " "))),
        F.when(F.size(topics) > 0, F.concat(F.lit(PHRASES["topics"]), F.array_join(some_topics, " "))),
        F.when(F.size(topics) > 0, F.array_join(F.transform(some_topics, lambda t: F.coalesce(F.element_at(hints, t), t)), " ")),
        F.when(F.size(topics) > 0, PHRASES["go_on"]).when(hint == "", PHRASES["nothing"]),
        extra,
    ]
    return strip(F.array_join(F.filter(F.array(*[blank(p) for p in parts]), lambda p: p != ""), " "))
