"""Sources, splitting, the store, states and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestream.operators import dialogue, splitting, store, views
from lodestream.operators.splitting import SplitConfig, split_records
from lodestream.sources import files
from lodestream.streaming import dialogue as streams


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p}{table}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "data"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "a.txt").write_text("第一章 总则\n正文内容在这里。", encoding="utf-8")
    (root / "sub" / "B.MD").write_text("# T\n\nbody text\n\n## U\nmore", encoding="utf-8")
    (root / "sub" / "deep" / "gb.txt").write_bytes("编码测试的文字。".encode("gb18030"))
    qa = [{"instruction": "问？", "output": "答。<INTENT>x</INTENT>", "system": "s"}, {"other": 1}, "plain item", 5, {"instruction": "", "output": ""}]
    (root / "sub" / "qa.json").write_text(json.dumps(qa, ensure_ascii=False), encoding="utf-8")
    (root / "one.json").write_text('{"k": "v"}', encoding="utf-8")
    (root / "bad.json").write_text("{nope", encoding="utf-8")
    (root / "rows.csv").write_text('name,note\nx,"two\nlines"\ny,\n', encoding="utf-8")
    (root / "d.docx").write_bytes(docx([("H1", "Head"), ("x", "Text of it.")]))
    (root / "skip.bin").write_bytes(b"1")
    return str(root)


def test_sources(spark, tree):
    scanned = files.scan_files(spark, tree)
    assert {r.relpath: r.tag for r in scanned.collect()} == {
        "a.txt": "general", "sub/B.MD": "sub", "sub/deep/gb.txt": "sub", "sub/qa.json": "sub", "one.json": "general", "bad.json": "general", "rows.csv": "general", "d.docx": "general",
    }
    records, failures = files.load_records(spark, tree)
    assert [r.source for r in failures.collect()] == ["bad.json"]
    by = {}
    for r in records.collect():
        by.setdefault(r.source, []).append(r)
    assert by["a.txt"][0].text.startswith("# 第一章 总则") and by["sub/deep/gb.txt"][0].text == "编码测试的文字。"
    assert [r.text for r in by["rows.csv"]] == ["name: x\nnote: two\nlines", "name: y\nnote:"]
    qa = sorted(by["sub/qa.json"], key=lambda r: r.page)
    assert (qa[0].record_type, qa[0].qa_index, qa[0].text) == ("qa_pair", 0, "系统：s\n问题：问？\n答案：答。")
    assert [r.record_type for r in qa[1:]] == ["json_item"] * 4 and qa[2].text == '"plain item"'
    assert by["d.docx"][0].text.startswith("# Head") and "| a | b |" in by["d.docx"][0].text
    registry = scanned.select("source", "doc_hash").where("source <> 'a.txt'")
    assert {r.source for r in files.load_records(spark, tree, registry)[0].collect()} == {"a.txt"}
    stats = files.load_stats(scanned, registry, failures).first()
    assert (stats.seen, stats.skipped, stats.failed) == (8, 7, 1)


def test_sections_and_merging():
    text = "pre\n[[PAGE=1]]\n# A\nabc def\n[[PAGE=2]]\ncut here。\n### C\nx\n\n\n\ny\n# B\n## D\n- item"
    got = [(s.path, s.content, s.page) for s in splitting.parse_sections(text)]
    assert got == [([], "pre", None), (["A"], "abc defcut here。", 1), (["A", "C"], "x\n\ny", 2), (["B"], "", 2), (["B", "D"], "- item", 2)]
    merged = splitting.merge_sections([splitting.Section(["A", "x"], "1"), splitting.Section(["A", "y"], "2"), splitting.Section(["B"], "3")], 100)
    assert [(s.path, s.content) for s in merged] == [(["A"], "◆ x\n1\n◆ y\n2"), (["B"], "3")]
    limit = [splitting.Section(["A", "x"], "a" * 10), splitting.Section(["A", "y"], "b" * 10)]
    assert len(splitting.merge_sections(limit, 10 + 4 + 10 + 1)) == 1 and len(splitting.merge_sections(limit, 10 + 4 + 10)) == 2


def test_sentences_groups_and_recursion():
    assert splitting.split_sentences("一。二！ 三\n- a。b\n| x。y\n◆ t。u") == ["一。", "二！", "三", "- a。b", "| x。y", "◆ t。u"]
    assert splitting.group_sentences(["aaa", "bbb", "ccc"], {0}, 6, 7) == ["aaa", "bbb\nccc"]
    assert splitting.group_sentences(["x" * 50], set(), 10, 20) == ["x" * 50]
    text = "。".join("字" * n for n in (30, 40, 20, 90, 10)) + "。"
    parts = splitting.recursive_split(text, 60, 10)
    assert all(len(p) <= 60 for p in parts) and set("".join(parts)) == set(text)
    assert "".join(splitting.recursive_split("abcdefghij" * 3, 7, 0)) == "abcdefghij" * 3
    with pytest.raises(ValueError):
        SplitConfig(chunk_size=10, overlap=10)


def test_split_records(spark):
    rows = [
        (0, "d/T_one.md", "# H\n" + "内容很长的一句话在这里。" * 3, None), (1, "d/x.md", "# h\n" + " 内容很长的一句话在这里。" * 3, None), (2, "q.json", "短", "qa_pair"), (3, "q.json", "短 ", "qa_pair"),
        (4, "e.txt", "太短", None), (5, "f.txt", "句子。" * 400, None), (6, "g.txt", None, None), (7, "h.json", "长" * 800, "json_item"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, record_type string")
    out = sorted(split_records(df).collect(), key=lambda r: (r.doc_id, r.chunk_id))
    assert [r.doc_id for r in out if r.doc_id < 5] == [0, 2] and out[0].text.startswith("【所属章节】T one > H\n") and out[0].section_path == "H"
    assert [r.split_method for r in out if r.doc_id == 2] == ["atomic"] and {r.split_method for r in out if r.doc_id in (5, 7)} == {"recursive"}
    for d in (5, 7):
        assert [r.chunk_id for r in out if r.doc_id == d] == list(range(sum(r.doc_id == d for r in out)))
    assert split_records(df.limit(0)).collect() == []


def test_store_round_trip(spark, tmp_path):
    row = lambda s, d, t, n: (s, "t", d, 0, 1, f"h{d}", None, "structure", None, t, n)
    old = spark.createDataFrame([row("a", 0, "one", 0), row("b", 0, "two", 1), row("b", 1, "TWO ", 2), row("c", 0, "", 3), row("./a", 1, "gone", 4)], store.CHUNK_SCHEMA)
    new = spark.createDataFrame([row("a", 0, "new", 10)], store.CHUNK_SCHEMA)
    assert sorted(r.text for r in store.upsert(old, new).collect()) == ["new", "two"]
    counts = store.prune(old, new.select("source"))[1].first()
    assert (counts.removed_replaced, counts.removed_duplicates) == (2, 2)
    assert store.upsert(old, new, incremental=False).count() == 1 and store.upsert(None, new).count() == 1
    root = str(tmp_path / "idx")
    assert store.read_snapshot(spark, root) is None
    store.write_snapshot(old, root)
    store.write_snapshot(new, root)
    assert [r.text for r in store.read_snapshot(spark, root).collect()] == ["new"]
    store.wipe(spark, root)
    assert store.read_snapshot(spark, root).count() == 0
    assert {r.text for r in store.delete(old, store.Selector(source="b", doc_ids=(1,))).collect()} == {"one", "two", "", "gone"}
    assert store.delete(old, store.Selector(metadata="b.json", delete_all=True)).where("source = 'b'").count() == 0
    for bad in ({}, {"source": "a", "metadata": "b", "delete_all": True}, {"source": "a"}, {"source": "a", "delete_all": True, "doc_ids": (1,)}):
        with pytest.raises(ValueError):
            store.Selector(**bad)
    with pytest.raises(ValueError):
        store.delete(old, store.Selector(metadata="zz.json", delete_all=True))
    store.write_mirror(old, root)
    assert spark.read.json(f"{root}/metadata").count() == 5


EVENTS = [
    ("v", 1, "ask", "您 怎么称呼<INTENT>x</INTENT>"), ("v", 2, "ask", "第二问"), ("v", 3, "utterance", "嗯"), ("v", 4, "utterance", "我想看车"), ("v", 5, "utterance", "我想看车"),
    ("v", 6, "utterance", "请求主动询问"), ("v", 7, "ask", "第三问"), ("v", 8, "utterance", "我想看车"), ("v", 9, "utterance", "第二句"), ("w", 1, "utterance", "你好啊"), ("w", 2, "ask", "a" * 200),
]


def test_memory_in_batch_and_as_a_stream(spark, tmp_path):
    many = EVENTS + [("x", i, "utterance" if i % 2 else "ask", f"text {i // 4}") for i in range(40)]
    df = spark.createDataFrame(many, "visitor string, seq long, kind string, text string")
    batch = {r.visitor: r for r in dialogue.memory(df).collect()}
    assert batch["v"].utterances == ["我想看车", "第二句"] and batch["v"].recent == ["您 怎么称呼", "第二问", "第三问"]
    assert [(p.ask, p.reply) for p in batch["v"].answered] == [("第二问", "我想看车"), ("第三问", "第二句")]
    assert batch["w"].pending == "a" * 120 and len(batch["x"].utterances) == 8
    source = str(tmp_path / "in")
    for lo, hi in ((0, 5), (5, 20), (20, 100)):
        df.where(F.col("seq").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(source)
    stream = streams.memory_stream(spark.readStream.schema(df.schema).parquet(source))
    q = stream.writeStream.outputMode("update").format("memory").queryName("memory_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.sql("select * from memory_out").collect():
        if r.visitor not in last or r.seq >= last[r.visitor].seq:
            last[r.visitor] = r
    for v, b in batch.items():
        assert last[v].utterances == b.utterances and last[v].recent == b.recent and (last[v].pending or None) == b.pending
        assert list(zip(last[v].asks, last[v].replies)) == [(p.ask, p.reply) for p in b.answered or []]


def test_marks_as_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("visitor"), F.col("event_type").alias("stage"), "ts")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.mark_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("marks_out").start()
    q.processAllAvailable()
    q.stop()
    from lodestream.operators import funnel

    assert sorted(map(repr, spark.sql("select * from marks_out").collect())) == sorted(map(repr, funnel.mark(events).collect()))


def test_visitor_states(spark):
    states = [
        ("a", json.dumps({"person_name": "张三", "updated_at": 10.0, "asked": True, "first_asked_at": 5.0, "tour_process": {"steps": [{"id": "greeting", "asked": True, "asked_at": 3.0}]},
                          "interest_profile": {"vehicles": {"X1": {"ask_count": "0", "last_asked_at": 2.0, "topics": {"price": {"count": 0}}}, "x2": {"ask_count": 3, "last_asked_at": 9.0}}},
                          "customer_memory": {"utterances": [{"text": f"u{i}"} for i in range(12)] + [{"text": " "}]}})),
        ("b", "{}"), ("c", "[1]"), ("d", "broken"),
    ]
    df = spark.createDataFrame(states, "key string, json string")
    norm = views.normalized(views.read_states(df))
    rows = {r.key: r for r in norm.collect()}
    assert "c" not in rows and "d" not in rows
    a = rows["a"]
    assert a.ask_name.asked and a.ask_name.first_asked_at == 5.0 and len(a.steps) == 9 and a.steps[0].asked and not a.steps[1].asked
    assert a.vehicles["x1"].ask_count == 1 and a.vehicles["x1"].topics["price"].title == "price" and a.last_vehicle_tag == "x2"
    assert [u.text for u in a.memory.utterances] == [f"u{i}" for i in range(4, 12)]
    listed = views.visitor_list(norm).collect()
    assert [r.key for r in listed] == ["a", "b"] and listed[0].n_done == 1 and listed[0].n_topics == 1
    detail = views.visitor_detail(norm, "a").first()
    assert [s.status for s in detail.steps[:3]] == ["done", "current", "pending"] and detail.entities == ["x2", "x1"]
    legacy = spark.createDataFrame([(json.dumps({"a": {"person_name": "x"}, "z": {"person_name": "y"}}),)], "json string")
    assert [r.key for r in views.migrate_legacy(legacy, df).collect()] == ["z"]
