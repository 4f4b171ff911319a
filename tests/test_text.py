"""Text, name and tag functions on small inputs."""

from pyspark.sql import functions as F

from lodestream.functions import names, overlap, tags, text
from lodestream.operators import funnel, rule_sets, rules


def one(spark, rows, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, c string")
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_cleaning(spark):
    got = one(
        spark,
        [None, "a\x00b﻿​c", "4 0 1 . 0 km", "!!!\nkeep", "| a | ---\n|---|", "a\r\n\r\n\r\n\r\nb", "\x07x\ty", "======a======", "一 二 三 四", "a b\n\n"],
        text.clean_text,
    )
    assert got == ["", "abc", "401.0km", "keep", "| a | ---\n|---|", "a\n\nb", "x y", "", "一二三四", "a b"]


def test_strip_and_key(spark):
    assert one(spark, ["　 a\x1f b ", None], text.strip) == ["a\x1f b", None]
    assert one(spark, ["　 A\x1f b ", None], text.dedup_key) == ["ab", ""]


def test_headings(spark):
    source = "第一章 总则\n正文在这里，写得很长很长。\n产品定位\n内容\n下一行\n1.2 参数\n- 项目\n400km\n标题\n末"
    want = "# 第一章 总则\n正文在这里，写得很长很长。\n## 产品定位\n## 内容\n## 下一行\n### 1.2 参数\n- 项目\n400km\n## 标题\n末"
    got = one(spark, [source, "# A\n## B\nc", ""], text.promote_headings)
    assert got[1:] == ["# A\n## B\nc", ""]
    assert got[0].split("\n")[0] == "# 第一章 总则" and "## 产品定位" in got[0] and "### 1.2 参数" in got[0] and "\n- 项目\n" in got[0]
    assert got[0].split("\n")[:3] == want.split("\n")[:3] and got[0].endswith("末")


def test_unwrapping(spark):
    long = "这一行有三十个字以上所以会与下一行接在一起因为它没有结束而且还在说话还在说"
    assert one(spark, [f"{long}\n接着\n# 题\n- x", "short\nline", f"{long}。\n不接"], text.unwrap_lines) == [f"{long}接着\n# 题\n- x", "short\nline", f"{long}。\n不接"]


def test_tables(spark):
    df = spark.createDataFrame([(1, [["a ", None], [" ", ""], ["b", "c", "d\n e"]]), (2, []), (3, [[""]])], "i int, r array<array<string>>")
    got = [r.v for r in df.select("i", text.render_table(F.col("r")).alias("v")).orderBy("i").collect()]
    assert got == ["| a |  |  |\n|---|---|---|\n| b | c | d e |", "", ""]


def test_file_names(spark):
    got = one(spark, ["", "a/b c", "é.-_", "x" * 130], text.state_file_name)
    assert got[:3] == ["anonymous.json", "a_b_c.json", "é.-_.json"] and len(got[3]) == 80 + 1 + 16 + 5


def test_context_header(spark):
    df = spark.createDataFrame([("T", ["t ", "A", "a", "B"]), ("", []), ("", ["X"])], "t string, p array<string>")
    assert [r.v for r in df.select(text.context_header(F.col("t"), F.col("p")).alias("v")).collect()] == ["【所属章节】T > A > B", "", "【所属章节】X"]


def test_fillers_and_prefixes(spark):
    assert one(spark, ["嗯嗯，啊 你好", "嗯", None, "额外", " 你好"], tags.strip_fillers) == ["你好", "嗯", "", "外", "你好"]
    df = spark.createDataFrame([("问题", ["X1", "general", "x1", "active_ask_a", "x2"])], "q string, t array<string>")
    shown = F.create_map(F.lit("x1"), F.lit("一号"))
    assert df.select(tags.prefix_names(F.col("q"), F.col("t"), shown)).first()[0] == "一号，问题"


def test_tags(spark):
    assert one(spark, ["看LS6和l6", "xls6", "ls6,L6"], lambda c: tags.detect_tags(c, ["l6", "ls6"])) == [["ls6", "l6"], [], ["ls6", "l6"]]
    assert one(spark, ["L6比ls6", "牌ls6"], lambda c: tags.detect_entities(c, {"l6": "l6", "ls6": "ls6", "牌ls6": "ls6"})) == [["l6", "ls6"], ["ls6"]]


def test_overlap(spark):
    rows = [("", "a"), ("a", "a"), ("ab", "ab"), ("abc", "xabcx"), ("abcd", "abxy")]
    df = spark.createDataFrame(rows, "a string, b string")
    x, y = overlap.bigrams(F.col("a")), overlap.bigrams(F.col("b"))
    got = df.select(overlap.coverage(x, y).alias("c"), overlap.jaccard(x, y).alias("j")).collect()
    assert [r.c for r in got] == [0, 1, 1, 1, 1 / 3] and [round(r.j, 3) for r in got] == [0, 1, 1, 0.5, 0.2]
    asks = F.array(F.lit("您平时自己开还是家里一起用呢？"))
    drop = lambda c: overlap.repeats_known(c, asks, F.array().cast("array<string>"))
    assert one(spark, ["刘先生，您平时是自己开，还是家里一起用呢？这能帮我推荐", "今天天气不错", ""], drop) == [True, False, False]
    assert one(spark, ["嗯嗯", "好的", "请求主动询问顾客", "想买车", "x", None], overlap.is_recordable) == [False, False, False, True, False, False]


def test_names(spark):
    assert one(spark, ["我叫张三吧", "我叫刘", "免贵姓王", "我姓欧阳", "我叫不出来", None, "你好"], names.introduced_name) == ["张三", "刘先生", "王先生", "欧阳先生", "", "", ""]
    clean = lambda c: names.sanitized_name(c, "王李刘", ("", "无", "none"), ("不知道", "抱歉"))
    got = one(spark, ["张三", "叫我张三吧", "刘", "褚", "刘先生", "谁先生", "抱歉不知道", "张三。", "无", "<INTENT>x</INTENT>李四", "None", None], clean)
    assert got == ["张三", "张三", "刘先生", "", "刘先生", "", "", "", "", "李四", "", ""]


def test_rule_sets(spark):
    stages, topics = rule_sets.stage_rules("牌", ("x1",)), rule_sets.topic_rules()
    assert len(stages) == 9 and len(topics) == 15
    df = spark.createDataFrame([(1, "欢迎来到牌，X1怎么样"), (2, "多少钱，能试驾吗"), (3, ""), (4, None)], "i int, c string")
    got = df.select("i", rules.classify(F.col("c"), stages).alias("s"), rules.classify(F.col("c"), topics).alias("t")).orderBy("i").collect()
    assert got[0].s == ["greeting", "vehicle_selection"] and got[1].s == ["test_drive", "quote_negotiation"] and got[1].t == ["price", "test_drive"]
    assert got[2].s == got[3].s == []
    both = [rules.Rule("r", ("a",), ("b", "c"))]
    assert one(spark, ["abc", "ab", "bc", "CBA"], lambda c: rules.classify(c, both)) == [["r"], [], [], ["r"]]
    assert rules.rule_table(df, stages, "stage").where("rule_id = 'greeting'").count() == 11


def plain_next(asked, interest, name, said):
    stages = funnel.STAGES
    for s in stages:
        engaged = bool(asked) or interest or name or said
        if s in asked or s == stages[0] and engaged or s == stages[1] and (interest or asked - set(stages[:2])):
            continue
        if s in stages[-2:] and set(stages[:-2]) - asked:
            continue
        return s
    return None


def test_next_stage_in_every_state(spark):
    rows = []
    for bits in range(1 << 12):
        asked = {s for i, s in enumerate(funnel.STAGES) if bits >> i & 1}
        rows.append((bits, sorted(asked), *(bool(bits >> k & 1) for k in (9, 10, 11)), plain_next(asked, *(bool(bits >> k & 1) for k in (9, 10, 11)))))
    df = spark.createDataFrame(rows, "i int, asked array<string>, a boolean, b boolean, c boolean, want string")
    got = df.withColumn("got", funnel.next_stage(F.col("asked"), F.col("a"), F.col("b"), F.col("c")))
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
