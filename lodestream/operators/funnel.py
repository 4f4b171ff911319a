"""Stages of a visit: marking, progress, and what comes next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages in order, those skipped once a visitor is engaged, and those that come last.
STAGES = (
    "greeting", "interest_probe", "needs_analysis", "vehicle_selection", "product_presentation", "test_drive", "quote_negotiation",
    "deal_confirmation", "contact_retention",
)
ICEBREAKERS, LATE = STAGES[:2], STAGES[-2:]


def _ids(stages: Sequence[str]) -> Column:
    return F.array(*[F.lit(s) for s in stages])


def mark(events: DataFrame, key: str = "visitor") -> DataFrame:
    """(visitor, stage, asked_at): the first time of each stage; later ones change nothing."""
    return events.groupBy(key, "stage").agg(F.min("ts").alias("asked_at"))


def asked_stages(marks: DataFrame, key: str = "visitor") -> DataFrame:
    return marks.groupBy(key).agg(F.array_sort(F.collect_set("stage")).alias("asked"))


def progress(asked: DataFrame, stages: Sequence[str] = STAGES, preview: int = 3) -> DataFrame:
    """Adds n_asked, n_stages, first_open, all_done and the preview of open stages."""
    open_ = F.filter(_ids(stages), lambda s: ~F.array_contains(F.col("asked"), s))
    more = F.when(F.size(open_) > preview, F.concat(F.lit(" 等"), F.size(open_).cast("string"), F.lit("项"))).otherwise("")
    return asked.withColumns(
        {
            "n_asked": F.size(F.array_intersect("asked", _ids(stages))),
            "n_stages": F.lit(len(stages)),
            "first_open": F.get(open_, F.lit(0)),
            "all_done": F.size(open_) == 0,
            "open_preview": F.concat(F.array_join(F.slice(open_, 1, preview), "、"), more),
        }
    )


def progress_line(asked: Column, stages: Sequence[str] = STAGES) -> Column:
    open_ = F.filter(_ids(stages), lambda s: ~F.array_contains(asked, s))
    tail = F.when(F.size(open_) > 3, F.concat(F.lit(" 等"), F.size(open_).cast("string"), F.lit("项"))).otherwise("")
    shown = F.when(F.size(open_) == 0, "无").otherwise(F.concat(F.array_join(F.slice(open_, 1, 3), "、"), tail))
    return F.concat(F.lit("观车进度 "), F.size(F.array_intersect(asked, _ids(stages))).cast("string"), F.lit(f"/{len(stages)}；待讲解："), shown)


def next_stage(asked: Column, has_interest: Column, has_name: Column, has_utterances: Column, stages: Sequence[str] = STAGES, ice: Sequence[str] = ICEBREAKERS, late: Sequence[str] = LATE) -> Column:
    """The first open stage that fits, or null.

    The greeting is skipped once a visitor is engaged, the probe once an interest or a later stage is
    known; late stages wait for all earlier ones that are not late, skipped ones too.
    """
    engaged = (F.size(asked) > 0) | has_interest | has_name | has_utterances
    beyond = has_interest | (F.size(F.array_except(asked, _ids(ice))) > 0)
    waiting = F.size(F.array_except(_ids([s for s in stages if s not in late]), asked)) > 0

    def fits(s: Column) -> Column:
        skipped = ((s == ice[0]) & engaged) | ((s == ice[1]) & beyond) | (s.isin(*late) & waiting)
        return ~F.array_contains(asked, s) & ~skipped

    return F.get(F.filter(_ids(stages), fits), F.lit(0))


def advance(asked: Column, stages: Sequence[str] = STAGES) -> Column:
    """The first open stage, marked by force; null if none is open."""
    return F.get(F.filter(_ids(stages), lambda s: ~F.array_contains(asked, s)), F.lit(0))


def ask_stage(known: Column, pending: Column, configured: Sequence[str] = STAGES) -> Column:
    """The stage to ask about: the next one; the last if a known visitor has none left; else the greeting."""
    return F.when(pending.isin(*configured), pending).when(known & pending.isNull(), LATE[-1]).otherwise(ICEBREAKERS[0])


def name_state(asks: DataFrame, key: str = "visitor") -> DataFrame:
    """(visitor, name_asked, first_asked_at, person_name) from events of kinds ask_name and set_name."""
    return asks.groupBy(key).agg(
        F.coalesce(F.bool_or(F.col("kind") == "ask_name"), F.lit(False)).alias("name_asked"),
        F.min(F.when(F.col("kind") == "ask_name", F.col("ts"))).alias("first_asked_at"),
        F.max_by(F.when(F.col("kind") == "set_name", F.col("value")), F.when(F.col("kind") == "set_name", F.col("ts"))).alias("person_name"),
    )


def should_reask(has_state: Column, asked_at: Column, now: Column, timeout: float) -> Column:
    """Whether to ask for the name again; a timeout of zero or less means never."""
    if timeout <= 0:
        return F.lit(False)
    return F.when(~has_state, True).when(asked_at.isNull(), True).otherwise(now - asked_at > timeout)


def name_flags(tries: Column, limit: int, got_name: Column) -> Column:
    """What the session does after an attempt to get the name: done, ask_again or give_up."""
    return F.when(got_name, "done").when(tries < limit, "ask_again").otherwise("give_up")
