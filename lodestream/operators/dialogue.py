"""What a dialogue leaves behind for each visitor, from an event log, in batch form.

Events are (visitor, seq, kind, text, ts), kind "ask" for a question put to the visitor and "utterance"
for what the visitor said. Windows are by visitor and bounded by what one visitor says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.overlap import is_recordable
from lodestream.functions.tags import GENERAL, merge_tags
from lodestream.functions.text import ask_text, strip

MAX_UTTERANCES, MAX_ANSWERED, MAX_RECENT = 8, 6, 6


def _rolling(df: DataFrame, value: Column, n: int, into: str) -> DataFrame:
    w = Window.partitionBy("visitor").orderBy("seq").rowsBetween(-(n - 1), 0)
    return df.withColumn(into, F.collect_list(value).over(w))


def recorded_utterances(events: DataFrame) -> DataFrame:
    """Utterances that are kept: those that say something and do not repeat the one kept before.

    A skipped repeat equals the one before it, so comparing with the previous recordable one is enough.
    """
    said = events.where((F.col("kind") == "utterance") & is_recordable(F.col("text"))).withColumn("text", strip(F.col("text")))
    w = Window.partitionBy("visitor").orderBy("seq")
    return said.withColumn("before", F.lag("text").over(w)).where("before is null or before <> text").drop("before")


def rolling_utterances(events: DataFrame) -> DataFrame:
    """The last 8 kept utterances after each."""
    return _rolling(recorded_utterances(events), F.col("text"), MAX_UTTERANCES, "utterances").select("visitor", "seq", "utterances")


def recorded_asks(events: DataFrame) -> DataFrame:
    asks = events.where(F.col("kind") == "ask").withColumn("text", ask_text(F.col("text")))
    return asks.where("text <> ''")


def recent_asks(events: DataFrame) -> DataFrame:
    """The last 6 asks after each that differs from the one before."""
    w = Window.partitionBy("visitor").orderBy("seq")
    fresh = recorded_asks(events).withColumn("before", F.lag("text").over(w)).where("before is null or before <> text")
    return _rolling(fresh, F.col("text"), MAX_RECENT, "recent").select("visitor", "seq", "recent")


def answered_asks(events: DataFrame) -> DataFrame:
    """(visitor, seq, ask, reply): each kept utterance with the last ask since the kept one before it.

    An ask is used up by the next kept utterance, whatever it says.
    """
    kept = recorded_utterances(events).select("visitor", "seq", "text", F.lit(None).cast("string").alias("ask"))
    both = kept.unionByName(recorded_asks(events).select("visitor", "seq", F.lit(None).cast("string").alias("text"), F.col("text").alias("ask")))
    order = Window.partitionBy("visitor").orderBy("seq")
    turn = F.count("text").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = both.withColumn("turn", turn)
    within = Window.partitionBy("visitor", "turn").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    paired = numbered.withColumn("ask", F.last("ask", ignorenulls=True).over(within))
    return paired.where("text is not null and ask is not null").select("visitor", "seq", "ask", F.col("text").alias("reply"))


def rolling_answered(events: DataFrame) -> DataFrame:
    """The last 6 answered asks after each."""
    pairs = answered_asks(events)
    return _rolling(pairs, F.struct("ask", "reply"), MAX_ANSWERED, "answered").select("visitor", "seq", "answered")


def pending_ask(events: DataFrame) -> DataFrame:
    """(visitor, ask): the last ask that no kept utterance has used up."""
    kept = recorded_utterances(events).groupBy("visitor").agg(F.max("seq").alias("last_said"))
    asks = recorded_asks(events).groupBy("visitor").agg(F.max_by("text", "seq").alias("ask"), F.max("seq").alias("asked"))
    return asks.join(kept, "visitor", "left").where("last_said is null or asked > last_said").select("visitor", "ask")


def memory(events: DataFrame) -> DataFrame:
    """(visitor, utterances, answered, recent, pending): what is known at the end of the log."""
    ends = []
    for df, column in ((rolling_utterances(events), "utterances"), (rolling_answered(events), "answered"), (recent_asks(events), "recent")):
        ends.append(df.groupBy("visitor").agg(F.max_by(column, "seq").alias(column)))
    out = events.select("visitor").distinct()
    for e in [*ends, pending_ask(events).withColumnRenamed("ask", "pending")]:
        out = out.join(e, "visitor", "left")
    return out


def sticky_tags(turns: DataFrame) -> DataFrame:
    """Tags in force after each turn (session, seq, detected, explicit, nav).

    ``explicit`` sets them outright and, if empty, clears the pinned ones; ``nav`` pins; detected tags are
    joined to what is pinned; a turn that does none of these goes on with pinned and last set tags. A general tag is added to any.
    """
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<string>")
    lower = lambda c: F.transform(c, F.lower)
    detected, explicit, nav = F.coalesce("detected", none), lower(F.col("explicit")), lower(F.col("nav"))
    pin = F.when(F.col("nav").isNotNull(), nav).when(F.size(F.col("explicit")) == 0, none)
    t = turns.withColumn("pin", pin).withColumn("pinned", F.coalesce(F.last("pin", ignorenulls=True).over(w), none))
    t = t.withColumn("pinned_before", F.coalesce(F.last("pin", ignorenulls=True).over(before), none))
    set_to = (
        F.when(F.col("nav").isNotNull(), merge_tags(nav, detected))
        .when(F.col("explicit").isNotNull(), explicit)
        .when(F.size(detected) > 0, merge_tags(F.col("pinned_before"), detected))
    )
    t = t.withColumn("set_to", set_to).withColumn("active", F.coalesce(F.last("set_to", ignorenulls=True).over(w), none))
    tags = F.when(F.col("set_to").isNotNull(), F.col("set_to")).otherwise(merge_tags(F.col("pinned"), F.col("active")))
    general = F.when((F.size(tags) > 0) & ~F.array_contains(tags, GENERAL), F.concat(tags, F.array(F.lit(GENERAL)))).otherwise(tags)
    return t.select("session", "seq", general.alias("tags"))


def sticky_value(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value that was set, carried on."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
