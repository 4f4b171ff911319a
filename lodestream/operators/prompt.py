"""Prompt assembly. Wording is data: a table of templates by name, with {placeholders}."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.names import is_person_name
from lodestream.functions.text import blank, strip

#: Plain defaults; pass your own table for other wording.
TEMPLATES: dict[str, str] = {
    "identity_named": "The visitor is called {name}.",
    "identity_unknown": "The visitor's name is not known.",
    "location_one": "You are at {places}.",
    "location_many": "You are near {places}.",
    "location_none": "You are at the entrance.",
    "visit": "The visitor wants to go to {places}.",
    "entity": "Speak about {entity} only.",
    "history": "Said before: {history}",
    "empty_context": "Nothing on record answers this; say so.",
    "context": "Records:\n{context}",
    "question": "Question: {query}",
    "closing": "Answer in short spoken sentences.",
    "progress": "Done: {done}. Open: {open}.",
    "stage": "Now: {stage}",
    "ask_name": "Ask for the visitor's name.",
    "extract_name": "Give the name in: {query}",
    "echo_name": "Greet {name} and go on.",
    "identity_new": "The visitor has just come in.",
    "identity_named_back": "{name} was here before.",
    "greeting_at": "Greet the visitor at {places}.",
    "visit_unknown": "The visitor wants to go somewhere; ask where.",
    "entity_many": "Compare {entities} fairly.",
    "hint": "Lead over to it from: {hint}",
    "progress_none": "Nothing has been covered yet.",
    "progress_all": "Everything has been covered.",
    "complete": "Leave nothing out that the records say.",
    "spoken": "Speak as in a talk, without lists.",
    "history_use": "Refer to what was said before, but do not repeat it.",
    "accurate": "Say only what the records hold.",
    "bounds": "Say so if something is beyond your reach.",
}
#: Blocks that never change, in order; the last two are off unless asked for.
STATIC, OPTIONAL = ("complete", "spoken", "history_use"), ("accurate", "bounds")


def fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), blank(value))
    return out


def lines(*parts: Column) -> Column:
    """Parts that say something, one to a line."""
    return F.array_join(F.filter(F.array(*[blank(p) for p in parts]), lambda p: p != ""), "\n")


def identity(name: Column, t: Mapping[str, str] = TEMPLATES) -> Column:
    return F.when(is_person_name(name), fill(t["identity_named"], name=strip(name))).otherwise(t["identity_unknown"])


def identity_line(name: Column, is_new: Column, seen: Column, t: Mapping[str, str] = TEMPLATES) -> Column:
    """Who is spoken to: a name that is one, back or not; else someone new, or not known."""
    named = F.when(seen, fill(t["identity_named_back"], name=strip(name))).otherwise(fill(t["identity_named"], name=strip(name)))
    return F.when(is_person_name(name), named).when(is_new, t["identity_new"]).otherwise(t["identity_unknown"])


def greeting_place(places: Column, t: Mapping[str, str] = TEMPLATES) -> Column:
    return F.when(F.size(places) > 0, fill(t["greeting_at"], places=F.array_join(places, ", "))).otherwise(t["location_none"])


def visit_block(wants: Column, places: Column, t: Mapping[str, str] = TEMPLATES) -> Column:
    """Where the visitor wants to go, or that it is not known; nothing if there is no such wish."""
    return F.when(wants, F.when(F.size(places) > 0, fill(t["visit"], places=F.array_join(places, ", "))).otherwise(t["visit_unknown"]))


def entity_block(entities: Column, t: Mapping[str, str] = TEMPLATES) -> Column:
    one = fill(t["entity"], entity=F.get(entities, F.lit(0)))
    return F.when(F.size(entities) == 1, one).when(F.size(entities) > 1, fill(t["entity_many"], entities=F.array_join(entities, ", ")))


def progress_block(done: Column, open_: Column, t: Mapping[str, str] = TEMPLATES, shown: int = 4) -> Column:
    both = fill(t["progress"], done=F.array_join(done, ", "), open=F.array_join(F.slice(open_, 1, shown), ", "))
    return F.when(F.size(done) == 0, t["progress_none"]).when(F.size(open_) == 0, t["progress_all"]).otherwise(both)


def static_blocks(optional: bool = False, t: Mapping[str, str] = TEMPLATES) -> Column:
    return F.lit("\n".join(t[b] for b in STATIC + (OPTIONAL if optional else ())))


def name_prompt(kind: str, query: Column | None = None, name: Column | None = None, t: Mapping[str, str] = TEMPLATES) -> Column:
    """The prompts around a name: ask_name, extract_name (from a query) and echo_name (of a name)."""
    values = {k: v for k, v in (("query", query), ("name", name)) if v is not None}
    return fill(t[kind], **values)


def location(places: Column, t: Mapping[str, str] = TEMPLATES) -> Column:
    named = F.array_join(places, ", ")
    return F.when(F.size(places) == 1, fill(t["location_one"], places=named)).when(F.size(places) > 1, fill(t["location_many"], places=named)).otherwise(t["location_none"])


def ordinary(query: Column, context: Column, name: Column, places: Column, visit: Column, entity: Column, history: Column, t: Mapping[str, str] = TEMPLATES) -> Column:
    """Identity, location, entity, visit, history, context or its lack, question, closing."""
    return lines(
        identity(name, t),
        location(places, t),
        F.when(blank(entity) != "", fill(t["entity"], entity=entity)),
        F.when(F.size(visit) > 0, fill(t["visit"], places=F.array_join(visit, ", "))),
        F.when(F.size(history) > 0, fill(t["history"], history=F.array_join(history, " / "))),
        F.when(strip(blank(context)) == "", t["empty_context"]).otherwise(fill(t["context"], context=context)),
        fill(t["question"], query=query),
        F.lit(t["closing"]),
    )


def active_ask(context: Column, name: Column, done: Column, open_: Column, places: Column, stage: Column, hint: Column | None = None, t: Mapping[str, str] = TEMPLATES) -> Column:
    """Identity, progress, location, the stage to ask about with a hint that leads to it, and context."""
    return lines(
        identity(name, t),
        progress_block(done, open_, t),
        location(places, t),
        fill(t["stage"], stage=stage),
        F.when(strip(blank(hint)) != "", fill(t["hint"], hint=hint)) if hint is not None else F.lit(""),
        F.when(strip(blank(context)) != "", fill(t["context"], context=context)),
    )


def route(obtain_name: Column, is_active: Column, ask_name: Column, extract: Column, active: Column, asking: Column, usual: Column) -> Column:
    """Which prompt: name extraction, active ask, asking the name, or the ordinary one."""
    return F.when(obtain_name, extract).when(is_active, active).when(ask_name, asking).otherwise(usual)
