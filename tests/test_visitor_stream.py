"""The visitors' stream over restarts, against a plain run of all turns and against the batch operators."""

import datetime as dt

from pyspark.sql import functions as F

from lodestream.operators import session
from lodestream.streaming import visitors
from lodestream.streaming.dialogue import fold

MINUTE = 60_000
START = dt.datetime(2024, 5, 1, 12, 0)
SCHEMA = "visitor string, seq long, ts timestamp, kind string, text string"
TURNS = [
    # (visitor, minute, kind, text), in files as they arrive
    [("a", 0, "ask", "What brings you here?"), ("a", 1, "say", "A look around"), ("b", 1, "ask_name", None), ("b", 2, "obtain", "12345"), ("c", 2, "say", "Hello there")],
    [("a", 5, "ask_name", None), ("a", 6, "obtain", "张三"), ("b", 7, "obtain", ""), ("c", 8, "ask", "For how long?"), ("c", 9, "say", "Some days"), ("d", 9, "ask_name", "")],
    [("a", 45, "say", "Something else"), ("b", 46, "say", None), ("d", 47, "obtain", "李四")],
    [("a", 300, "say", "Back again"), ("c", 301, "say", "Here anew")],
]
LIMIT, REASK, IDLE = 3, 30 * MINUTE, 120 * MINUTE


def numbered():
    seq = 0
    for part in TURNS:
        rows = []
        for v, minute, kind, text in part:
            seq += 1
            rows.append((v, seq, START + dt.timedelta(minutes=minute), kind, text))
        yield rows


def test_over_restarts(spark, tmp_path):
    source, checkpoint, states = (str(tmp_path / x) for x in ("turns", "checkpoint", "states"))
    seen = []

    def keep(batch, batch_id):
        seen.extend(r.asDict() for r in batch.collect())
        visitors.state_sink(states)(batch, batch_id)

    for rows in numbered():
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        turns = spark.readStream.schema(SCHEMA).parquet(source)
        out = visitors.visitor_stream(turns, LIMIT, REASK, IDLE, "1 minute")
        # Each file is read by a query of its own, which goes on from what the one before has left.
        query = out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()

    base = spark.createDataFrame([(START,)], "ts timestamp").select(F.unix_millis("ts")).first()[0]
    events = [(r["event"], r["visitor"], (r["at_ms"] - base) // MINUTE) for r in seen if r["event"] != "memory"]
    # b was asked at 1 and never said; d gave the name after its time, in one batch with it; a gave it in time.
    assert sorted(e for e in events if e[0] == "reask") == [("reask", "b", 31), ("reask", "d", 39)]
    assert sorted(e for e in events if e[0] == "evicted") == [("evicted", "a", 165), ("evicted", "b", 166), ("evicted", "c", 129), ("evicted", "d", 167)]

    last = {r["visitor"]: r for r in visitors.read_states(spark, states).collect()}
    assert set(last) == {"a", "b", "c", "d"}
    # Those who came back began anew: a visitor is made once until it is let go.
    assert last["a"].utterances == ["Back again"] and last["c"].utterances == ["Here anew"] and last["a"].person_name is None
    assert (last["a"].created_ms - base) // MINUTE == 300 and (last["b"].created_ms - base) // MINUTE == 1
    assert last["d"].event == "evicted" and last["d"].person_name == "李四"

    # Before anyone was let go, memories are those of a plain run over all turns.
    plain = {}
    for rows in list(numbered())[:3]:
        for v, _, _, kind, text in rows:
            state = plain.setdefault(v, {"utterances": [], "asks": [], "replies": [], "recent": [], "pending": ""})
            if kind in ("ask", "say"):
                fold(state, kind, text)
    gone = {r["visitor"]: r for r in seen if r["event"] == "evicted"}
    for v, state in plain.items():
        assert {k: gone[v][k] for k in state} == state


def test_attempts_are_those_of_the_batch_operator(spark, tmp_path):
    kinds = ["ask_name", "obtain", "say", "obtain", "ask_name", "obtain", "obtain", "obtain", "ask_name", "obtain", "say"]
    rows = []
    for v in range(4):
        for i, kind in enumerate(kinds):
            name = "张三" if kind == "obtain" and (i + v) % 4 == 3 else "7"
            rows.append((f"v{v}", len(rows), START + dt.timedelta(seconds=len(rows)), kind, name))
    source, checkpoint = str(tmp_path / "turns"), str(tmp_path / "checkpoint")
    seen = {}
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] % 44 // 15 == part], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        turns = spark.readStream.schema(SCHEMA).parquet(source)
        out = visitors.visitor_stream(turns, LIMIT, REASK, IDLE, "1 minute")
        query = out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query.foreachBatch(lambda b, _: seen.update({r.visitor: (r.waiting, r.attempts) for r in b.collect()})).start().awaitTermination()
    turns = spark.createDataFrame(rows, SCHEMA).select(
        F.col("visitor").alias("session"), "visitor", "seq", F.when(F.col("kind") == "ask_name", "ask").when(F.col("kind") == "obtain", "obtain").otherwise("chat").alias("kind"), F.col("text").alias("name")
    )
    last = session.name_attempts(turns, LIMIT).groupBy("session").agg(F.max_by(F.struct("waiting", "attempts"), "seq").alias("x"))
    assert seen == {r.session: (r.x.waiting, r.x.attempts) for r in last.collect()}
