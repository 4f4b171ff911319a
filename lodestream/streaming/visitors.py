"""Visitors as a stateful stream: made when first seen, timed out when a name is not given, let go when idle.

State lives in RocksDB by visitor: a value for what changes with every turn, lists for what was said and asked. Two
event-time timers stand for each visitor: one fires when the name was asked for and not given in time, the other
when nothing was heard for long; the latter gives the memory out a last time and clears the state, so what is held
is bounded by the visitors that are active.

Turns (visitor, seq, ts, kind, text) are applied in order of seq within a batch; kinds are "ask" and "say" as in
``dialogue.fold``, "ask_name", and "obtain" with a name, or what is none, in text. Defined results: a turn that is
not later than one applied before is left out; null texts count as empty; a visitor that comes back after being let
go begins anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestream.functions.names import is_person_name
from lodestream.functions.text import blank, strip
from lodestream.streaming.dialogue import fold

NAME_ATTEMPTS = 3
REASK_MS, IDLE_MS, LATE = 30 * 60 * 1000, 24 * 60 * 60 * 1000, "10 minutes"
LISTS = ("utterances", "asks", "replies", "recent")
PROFILE = "created long, last_seq long, last_at long, pending string, waiting boolean, attempts int, asked_at long, person_name string, reask_at long, idle_at long"
OUTPUT = (
    "visitor string, event string, at_ms long, seq long, created_ms long, utterances array<string>, asks array<string>, replies array<string>, "
    "recent array<string>, pending string, waiting boolean, attempts int, person_name string"
)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = [f.split()[0] for f in PROFILE.split(", ")]


def _new(at: int) -> dict[str, Any]:
    values = (at, -1, at, "", False, 0, None, None, None, None)
    return dict(zip(_FIELDS, values, strict=True)) | {name: [] for name in LISTS}


class Visitor(StatefulProcessor):
    def __init__(self, limit: int, reask_ms: int, idle_ms: int) -> None:
        self.limit, self.reask_ms, self.idle_ms = limit, reask_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", PROFILE)
        self.lists = {name: handle.getListState(name, "text string") for name in LISTS}

    def close(self) -> None:
        pass

    def _load(self, first_at: int) -> dict[str, Any]:
        """The visitor's state, made where there is none."""
        held = self.profile.get() if self.profile.exists() else None
        if held is None:
            return _new(first_at)
        state = dict(zip(_FIELDS, held, strict=True))
        return state | {name: [x[0] for x in s.get()] if s.exists() else [] for name, s in self.lists.items()}

    def _save(self, state: dict[str, Any]) -> None:
        self.profile.update(tuple(state[f] for f in _FIELDS))
        for name, s in self.lists.items():
            if state[name]:
                s.put([(x,) for x in state[name]])
            elif s.exists():
                s.clear()

    def _timer(self, state: dict[str, Any], field: str, at: int | None) -> None:
        other = state["idle_at" if field == "reask_at" else "reask_at"]
        if state[field] == at:
            return
        if state[field] is not None and state[field] != other:
            self.handle.deleteTimer(state[field])
        state[field] = at
        if at is not None and at != other:
            self.handle.registerTimer(at)

    def _row(self, key: Any, state: dict[str, Any], event: str, at: int) -> pd.DataFrame:
        row = {"visitor": key[0], "event": event, "at_ms": at, "seq": state["last_seq"], "created_ms": state["created"]}
        row |= {f: state[f] for f in (*LISTS, "pending", "waiting", "attempts", "person_name")}
        return pd.DataFrame([row])

    def _expire(self, key: Any, state: dict[str, Any], now: int) -> list[pd.DataFrame]:
        """What has run out before a turn at ``now``, whether or not the watermark has got there: so it does not matter
        how turns are dealt to batches."""
        out, idle_at = [], state["last_at"] + self.idle_ms
        if state["reask_at"] is not None and state["reask_at"] < now and state["reask_at"] <= idle_at:
            out.append(self._row(key, state, "reask", state["reask_at"]))
            self._timer(state, "reask_at", None)
            state["asked_at"] = None
        if idle_at < now and state["last_seq"] >= 0:
            out.append(self._row(key, state, "evicted", idle_at))
            self._timer(state, "reask_at", None)
            state |= _new(now) | {"idle_at": state["idle_at"]}
        return out

    def _turn(self, state: dict[str, Any], kind: str, text: str, named: bool, at: int) -> None:
        if kind == "ask_name":
            state |= {"waiting": True, "attempts": 0}
            if state["asked_at"] is None:
                state["asked_at"] = at
                if state["person_name"] is None:
                    self._timer(state, "reask_at", at + self.reask_ms)
        elif kind == "obtain":
            if named:
                state |= {"waiting": False, "attempts": 0, "person_name": text.strip()}
                self._timer(state, "reask_at", None)
            elif state["waiting"]:
                state["attempts"] += 1
                if state["attempts"] >= self.limit:
                    state |= {"waiting": False, "attempts": 0}
        else:
            fold(state, kind, text)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turns = pd.concat(list(rows)).sort_values("seq", kind="stable")
        state = self._load(int(turns["at_ms"].iloc[0]))
        for seq, at, kind, text, named in zip(*(turns[c].tolist() for c in ("seq", "at_ms", "kind", "text", "named")), strict=True):
            if seq > state["last_seq"]:
                yield from self._expire(key, state, at)
                self._turn(state, kind, text, named, at)
                state |= {"last_seq": int(seq), "last_at": max(state["last_at"], int(at))}
        self._timer(state, "idle_at", state["last_at"] + self.idle_ms)
        self._save(state)
        yield self._row(key, state, "memory", state["last_at"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        state = self._load(at)
        out = []
        if at == state["reask_at"]:
            # Asked anew from here on: the next time the name is asked for starts the clock again.
            state |= {"reask_at": None, "asked_at": None}
            out.append(self._row(key, state, "reask", at))
        if at == state["idle_at"]:
            if state["reask_at"] is not None:
                self.handle.deleteTimer(state["reask_at"])
            out.append(self._row(key, state, "evicted", at))
            self.profile.clear()
            for s in self.lists.values():
                if s.exists():
                    s.clear()
        else:
            self._save(state)
        yield from out


def visitor_stream(events: DataFrame, limit: int = NAME_ATTEMPTS, reask_ms: int = REASK_MS, idle_ms: int = IDLE_MS, late: str = LATE) -> DataFrame:
    """Rows of kinds memory (after each batch with turns), reask and evicted, of a stream of turns; for update mode.

    A timer fires when the watermark, the latest time seen less ``late``, has passed it.
    """
    conf = events.sparkSession.conf
    if conf.get(_PROVIDER, "") != _ROCKSDB:
        conf.set(_PROVIDER, _ROCKSDB)  # the only one that keeps timers and several states
    turns = events.withWatermark("ts", late).select(
        F.col("visitor").cast("string").alias("visitor"), "seq", "ts", F.unix_millis("ts").alias("at_ms"), "kind", blank(F.col("text")).alias("text"),
        is_person_name(strip(blank(F.col("text")))).alias("named"),
    )
    return turns.groupBy("visitor").transformWithStateInPandas(Visitor(limit, reask_ms, idle_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def state_sink(root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: visitors' memories as files below ``root``, a folder a batch, so a batch that is run again
    replaces what it had written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.where("event <> 'reask'").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def read_states(spark: SparkSession, root: str) -> DataFrame:
    """The last memory written of each visitor."""
    rows = spark.read.option("basePath", root).schema(OUTPUT + ", batch long").parquet(root)
    row = F.struct(*[c for c in rows.columns if c not in ("visitor", "batch")])
    return rows.groupBy("visitor").agg(F.max_by(row, F.struct("batch", "at_ms")).alias("row")).select("visitor", "row.*")
