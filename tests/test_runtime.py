"""Configuration and timings; arrays that run on; sessions."""

import time

import pytest
from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.functions.scan import running, running_state
from lodestream.operators import prompt, runtime, session, store
from lodestream.operators.rules import Rule, classify
from lodestream.plans import session_queries


def test_configuration(tmp_path):
    good, bad = tmp_path / "a.yaml", tmp_path / "b.yaml"
    good.write_text('{"paths": {"data_dir": "/x/y"}, "k": 8}')
    bad.write_text("[1, 2")
    assert runtime.load_config(good)["k"] == 8
    assert runtime.load_config(bad) == runtime.load_config(tmp_path / "none") == {}
    paths = runtime.resolve_paths(runtime.load_config(good))
    assert str(paths["data_dir"]) == "/x/y" and paths["index_dir"].is_absolute() and set(paths) == set(runtime.FOLDERS)


def test_timings():
    t = runtime.Timings()
    with t.part("a"), t.part("b"):
        time.sleep(0.01)
    assert set(t.report()) == {"a", "b", "total"} and t.report()["total"] >= 0.02


def test_running(spark):
    df = spark.createDataFrame([([3, 1, 4, 1, 5],), ([],), ([7],), (None,)], "a array<int>")
    got = [r[0] for r in df.select(running(F.col("a"), lambda x, y: x + y, F.lit(0))).collect()]
    assert got == [[3, 4, 8, 9, 14], [], [7], None]
    flips = spark.createDataFrame([([True, False, False, True], [True, False, True, False])], "f array<boolean>, t array<boolean>")
    for start, want in ((False, [True, False, False, True]), (True, [True, False, False, True])):
        assert flips.select(running_state(F.col("f"), F.col("t"), start)).first()[0] == want


@pytest.mark.parametrize("f", [text.promote_headings, text.unwrap_lines])
def test_time_grows_with_the_lines(spark, f):
    def seconds(n):
        lines = [f"line number {i} of a text that is long enough to wrap" if i % 3 else "Short title" for i in range(n)]
        df = spark.createDataFrame([("\n".join(lines),)], "t string")
        at = time.perf_counter()
        df.select(F.length(f(F.col("t")))).collect()
        return time.perf_counter() - at

    seconds(1000)
    assert seconds(40_000) < 8 * seconds(10_000) + 2


def test_a_batch_of_nothing(spark):
    empty = spark.createDataFrame([], store.CHUNK_SCHEMA)
    with pytest.raises(ValueError):
        store.upsert(None, empty)
    assert store.mirror_listing(empty).collect() == [] and store.mirror_detail(empty, "x.json").collect() == []
    assert store.preview_parts(empty, "source", "chunk_id", "page").collect() == []


def test_odd_turns(spark):
    rules = [Rule("price", ("price|cost",)), Rule("seat", ("seat",))]
    rows = [(1, 1, 1.0, "what does it cost"), (1, 2, 2.0, None), (1, 3, 3.0, "the price, and a seat"), (None, 4, 4.0, "a seat"), (1, 3, 3.0, "the price, and a seat")]
    turns = spark.createDataFrame(rows, "visitor long, seq long, ts double, text string")
    out = session.mark_from_texts(turns, rules, rules, {"beetle": "beetle"})
    assert {(r.visitor, r.seq, tuple(r.stages)) for r in out["newly_marked"].collect()} == {(1, 1, ("price",)), (1, 3, ("seat",)), (None, 4, ("seat",))}
    none = session.mark_from_texts(turns.limit(0), rules, rules, {"beetle": "beetle"})
    assert all(df.collect() == [] for df in none.values())
    hits = spark.createDataFrame([(1, "what does it cost"), (2, "what does it cost"), (None, "x"), (1, None)], "visitor long, text string")
    left = session.drop_asked(hits, turns.select("visitor", "text"))
    assert sorted(left.collect(), key=repr) == sorted(hits.where("not (visitor <=> 1 and text is not null)").collect(), key=repr)


def test_name_prompts(spark):
    row = spark.range(1).select(
        prompt.name_prompt("echo_name", name=F.lit("张三")).alias("echo"),
        prompt.progress_block(F.array().cast("array<string>"), F.array(F.lit("a"))).alias("none"),
        prompt.static_blocks(True).alias("blocks"),
        prompt.greeting_place(F.array().cast("array<string>")).alias("place"),
    ).first()
    assert "张三" in row.echo and row.none == prompt.TEMPLATES["progress_none"] and row.blocks.count("\n") == 4
    assert row.place == prompt.TEMPLATES["location_none"]


def test_edges_of_words_are_ascii(spark):
    rule = [Rule("ending", ("ment\\b", "\\bvis\\B"), ("\\w\\\\?",))]
    given = ["onmentç èen", "mentß", "Ment", "ment_x", "mentor", "év visé", "èvisit", "ævis", None]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", classify(F.col("t"), rule).alias("c")).collect()
    assert [r.i for r in sorted(rows) if r.c] == [0, 1, 2, 6]


def test_letters_beyond_ascii_end_a_word_in_marks(spark):
    rules = [Rule("ending", ("ment\\b",))]
    turns = spark.createDataFrame([(1, 1, 1.0, "the onmentç"), (1, 2, 2.0, "a ment")], "visitor long, seq long, ts double, text string")
    out = session.mark_from_texts(turns, rules, rules, {"the": "the"})
    assert [(r.seq, r.stages) for r in out["newly_marked"].collect()] == [(1, ["ending"])]


def test_letters_beyond_ascii_end_a_word_in_topics(spark):
    rules = [Rule("ending", ("ment\\b",))]
    turns = spark.createDataFrame([(1, 1, 1.0, "the onmentç"), (1, 2, 2.0, "a ment")], "visitor long, seq long, ts double, text string")
    out = session.mark_from_texts(turns, rules, rules, {"the": "the"})
    assert [(r.entity, r.topic, r.n) for r in out["topics"].collect()] == [("the", "ending", 2)]


def test_marks_of_turns_without_a_place_come_last(spark):
    rules = [Rule("price", ("price",))]
    turns = spark.createDataFrame([(1, None, 1.0, "the price"), (1, 5, 2.0, "a price"), (2, None, 1.0, "a price")], "visitor long, seq long, ts double, text string")
    out = session.mark_from_texts(turns, rules, rules, {"the": "the"})
    assert {(r.visitor, r.seq) for r in out["newly_marked"].collect()} == {(1, 5), (2, None)}


def test_topics_of_turns_without_a_place_come_last(spark):
    rules = [Rule("price", ("price",))]
    turns = spark.createDataFrame([(1, None, 1.0, "the seat"), (1, 5, 2.0, "a price"), (2, 1, 1.0, "the seat"), (2, None, 2.0, "a price")], "visitor long, seq long, ts double, text string")
    out = session.mark_from_texts(turns, rules, rules, {"the": "the"})
    assert [(r.visitor, r.entity, r.topic, r.n) for r in out["topics"].collect()] == [(2, "the", "price", 1)]


def test_topics_of_turns_that_share_a_place_go_by_conversation(spark, tmp_path):
    rows = [(1, 5, "user", "a nation"), (0, 105, "user", "the seat")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert list(map(tuple, session_queries.topics_from_texts(spark, str(tmp_path)).collect())) == [(0, "the", "ending", 1)]
