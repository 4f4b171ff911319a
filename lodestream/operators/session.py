"""What a turn of a conversation does to a visitor's state, and the view that prompts are made from.

Turns are (visitor, seq, ts, text); windows are by visitor and bounded by what one visitor says.
Defined results: null texts count as empty; commands of the system leave no trace; turns without a seq come
after all others; an empty log gives empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.names import is_person_name
from lodestream.functions.overlap import QUESTION_COVERAGE, UTTERANCE_COVERAGE, asked_texts, is_command
from lodestream.functions.text import blank, strip
from lodestream.operators import funnel, interest
from lodestream.operators.repeats import drop_covered
from lodestream.operators.rules import Rule, classify, preferences


def marked_turns(turns: DataFrame, stages: Sequence[Rule], topics: Sequence[Rule], aliases: dict[str, str]) -> DataFrame:
    """Turns with the stages, entities and topics that their texts name; commands are left out."""
    none = F.array().cast("array<string>")
    entities, found = preferences(F.col("text"), topics, aliases, none)
    said = turns.where(~is_command(F.col("text"))).withColumn("text", blank(F.col("text")))
    return said.withColumns({"stages": classify(F.col("text"), stages), "entities": entities, "topics": found})


def mark_from_texts(turns: DataFrame, stages: Sequence[Rule], topics: Sequence[Rule], aliases: dict[str, str]) -> dict[str, DataFrame]:
    """All that a batch of turns changes: marks, newly_marked by turn, entities and topics asked about."""
    marked = marked_turns(turns, stages, topics, aliases)
    each = marked.select("visitor", "seq", "ts", F.explode("stages").alias("stage"))
    first = Window.partitionBy("visitor", "stage").orderBy(F.col("seq").asc_nulls_last())
    new = each.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    attributed = interest.attribute_turns(marked)
    return {
        "marks": funnel.mark(each),
        "newly_marked": new.groupBy("visitor", "seq").agg(F.array_sort(F.collect_list("stage")).alias("stages")),
        "entities": interest.entity_counts(attributed),
        "topics": interest.topic_counts(attributed),
    }


def all_asked(last_ask: Column, answered: Column) -> Column:
    """The texts a visitor was asked: the last ask and the answered ones, each once, blanks left out."""
    return F.array_distinct(F.concat(F.filter(F.array(strip(blank(last_ask))), lambda a: a != ""), asked_texts(answered)))


def drop_asked(hits: DataFrame, asks: DataFrame, limit: float = QUESTION_COVERAGE) -> DataFrame:
    """Hits (visitor, text) that none of the visitor's asks (visitor, text) covers; blank asks cover nothing.

    Each text meets the visitor's asks in blocks; see ``repeats``.
    """
    return drop_covered(hits, asks.select("visitor", "text"), limit)


def drop_said(hits: DataFrame, said: DataFrame, limit: float = UTTERANCE_COVERAGE) -> DataFrame:
    """Hits (visitor, seq, text) that nothing the visitor said before, in ``said`` (visitor, seq, text), covers.

    Rows of ``said`` without a seq come before nothing, and nothing comes before hits without one.
    """
    earlier = said.where(F.col("seq").isNotNull()).select("visitor", "text", F.col("seq").alias("at"))
    return drop_covered(hits, earlier, limit, "seq")


def ask_context(states: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """The read-only view for active asks, of states (visitor, person_name, asked, utterances, answered,
    last_ask, recent, interest_summary): done and open titles, the current stage, and what was said."""
    named = F.create_map(*[x for s in funnel.STAGES for x in (F.lit(s), F.lit((titles or {}).get(s, s)))])
    stages = F.array(*[F.lit(s) for s in funnel.STAGES])
    asked = F.coalesce("asked", F.array().cast("array<string>"))
    said = F.coalesce("utterances", F.array().cast("array<string>"))
    name = strip(blank(F.col("person_name")))
    current = funnel.next_stage(asked, strip(blank(F.col("interest_summary"))) != "", name != "", F.size(said) > 0)

    def title(s: Column) -> Column:
        return F.element_at(named, s)

    done = F.transform(F.filter(stages, lambda s: F.array_contains(asked, s)), title)
    return states.select(
        "visitor",
        name.alias("person_name"),
        done.alias("done_titles"),
        F.transform(F.filter(stages, lambda s: ~F.array_contains(asked, s)), title).alias("pending_titles"),
        F.coalesce(current, F.lit("")).alias("current_step_id"),
        F.coalesce(title(current), F.lit("")).alias("current_step_title"),
        blank(F.col("interest_summary")).alias("interest_summary"),
        ((F.size(done) == 0) & (name == "") & (F.size(said) == 0)).alias("is_new_visitor"),
        said.alias("customer_utterances"),
        F.col("answered").alias("answered_asks"),
        strip(blank(F.col("last_ask"))).alias("last_active_ask_text"),
        F.col("recent").alias("recent_ask_texts"),
    )


def name_attempts(turns: DataFrame, limit: int) -> DataFrame:
    """Session flags after each attempt, from turns (session, seq, visitor, kind, name).

    Kind "ask" waits for the name of its visitor; "obtain" tries to read it; "chat" is any other turn. A
    session waits on until a name is read, ``limit`` attempts have failed, or another visitor chats. Adds
    waiting, attempts (0 when it no longer waits) and pending (whose name it waits for).
    """
    order = Window.partitionBy("session").orderBy("seq")
    ask = F.col("kind") == "ask"
    # Each ask opens a stretch; what ends one leaves the rest of it idle.
    stretch = turns.withColumn("stretch", F.sum(ask.cast("int")).over(order))
    within = Window.partitionBy("session", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.first(F.when(ask, F.col("visitor")), ignorenulls=True).over(within)
    failed = (F.col("kind") == "obtain") & ~is_person_name(F.col("name"))
    rows = stretch.withColumns({"asked": asked, "failures": F.sum(failed.cast("int")).over(within)})
    got = (F.col("kind") == "obtain") & is_person_name(F.col("name"))
    left = (F.col("kind") == "chat") & ~F.col("visitor").eqNullSafe(F.col("asked"))
    ended = F.max((got | left | (F.col("failures") >= limit)).cast("int")).over(within) == 1
    waiting = (F.col("stretch") > 0) & ~ended
    return rows.select(
        "session",
        "seq",
        waiting.alias("waiting"),
        F.when(waiting, F.col("failures")).otherwise(0).alias("attempts"),
        F.when(waiting, F.col("asked")).alias("pending"),
    )


def commit_names(found: DataFrame, states: DataFrame) -> DataFrame:
    """States (visitor, person_name) after names (visitor, seq, name) were found; names that are none change nothing."""
    valid = found.where((strip(blank(F.col("visitor").cast("string"))) != "") & is_person_name(F.col("name")))
    last = valid.groupBy("visitor").agg(F.max_by(strip(F.col("name")), "seq").alias("found_name"))
    return states.join(last, "visitor", "left").withColumn("person_name", F.coalesce("found_name", "person_name")).drop("found_name")
