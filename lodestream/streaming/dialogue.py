"""Dialogue state as streams; on a bounded input the results are those of the batch operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.operators.dialogue import MAX_ANSWERED, MAX_RECENT, MAX_UTTERANCES
from lodestream.functions.overlap import BACKCHANNEL, COMMAND_PREFIX

STATE = "utterances array<string>, asks array<string>, replies array<string>, recent array<string>, pending string, last_seq long"
OUTPUT = "visitor string, seq long, utterances array<string>, asks array<string>, replies array<string>, recent array<string>, pending string"
_SILENT = re.compile(BACKCHANNEL)


def fold(state: dict, kind: str, text: str) -> None:
    """One event's effect on a visitor's memory."""
    bare = (text or "").strip()
    if kind == "ask":
        bare = " ".join(re.sub(r"(?is)<INTENT>.*?</INTENT>", "", bare).split())[:120]
        if bare:
            state["pending"] = bare
            if state["recent"][-1:] != [bare]:
                state["recent"] = [*state["recent"], bare][-MAX_RECENT:]
    elif len(bare) >= 2 and not bare.startswith(COMMAND_PREFIX) and not _SILENT.match(bare) and state["utterances"][-1:] != [bare]:
        state["utterances"] = [*state["utterances"], bare][-MAX_UTTERANCES:]
        if state["pending"]:
            state["asks"] = [*state["asks"], state["pending"]][-MAX_ANSWERED:]
            state["replies"] = [*state["replies"], bare][-MAX_ANSWERED:]
            state["pending"] = ""


def memory_stream(events: DataFrame) -> DataFrame:
    """Memory of each visitor after each batch of events (visitor, seq, kind, text).

    Events of a visitor are applied in order of seq within a batch; one that comes after a later one was
    applied is left out, as memory holds no history to insert it into.
    """
    fields = [f.split()[0] for f in STATE.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(fields, group.get, strict=True)) if group.exists else {f: [] for f in fields[:4]} | {"pending": "", "last_seq": -1}
        state = {k: list(v) if k in fields[:4] else v for k, v in held.items()}
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        for seq, kind, text in zip(rows["seq"], rows["kind"], rows["text"], strict=True):
            if seq > state["last_seq"]:
                fold(state, kind, text)
                state["last_seq"] = int(seq)
        group.update(tuple(state[f] for f in fields))
        yield pd.DataFrame([{"visitor": key[0], "seq": state["last_seq"]} | {f: state[f] for f in fields[:5]}])

    return events.groupBy("visitor").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def mark_stream(events: DataFrame) -> DataFrame:
    """First time of each (visitor, stage), for update or complete mode."""
    return events.groupBy("visitor", "stage").agg(F.min("ts").alias("asked_at"))


def interest_stream(events: DataFrame) -> DataFrame:
    """Ask counts of each (visitor, entity), for update or complete mode."""
    return events.groupBy("visitor", "entity").agg(F.count("*").alias("ask_count"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def activity_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Extension: events by type in event-time windows; those later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def tail_text(spark, path: str) -> DataFrame:
    """Lines appended to the files of a folder, as a stream."""
    return spark.readStream.format("text").load(path)
