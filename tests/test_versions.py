"""The versioned store: what a batch rewrites, and who wins a race."""

import pytest

from lodestream.operators import store
from lodestream.operators.versions import CommitConflict, VersionedStore

COLUMNS = "source string, tag string, doc_id long, chunk_id int, text string, ingest_seq long"


def chunks(spark, seq, *sources, words=("one", "two", "three")):
    rows = []
    for s in sources:
        for i, w in enumerate(words):
            rows.append((s, "t", 1, i, f"{w} of {s}", seq + len(rows)))
    return spark.createDataFrame(rows, COLUMNS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_equal_those_of_the_plain_store(spark, tmp_path):
    v = VersionedStore(spark, str(tmp_path), 8)
    assert v.read() is None and v.versions() == []
    batches = [
        chunks(spark, 0, "a.md", "b.md", "c.md"),
        chunks(spark, 100, "b.md", words=("one", "new")),
        # A text that the store has already under another source: the later copy goes with the next batch.
        spark.createDataFrame([("d.md", "t", 1, 0, "One  of A.md", 200), ("d.md", "t", 1, 1, "of its own", 201), (None, "t", 2, 0, "nowhere", 202)], COLUMNS),
        chunks(spark, 300, "e.md"),
        chunks(spark, 400, "A.md", words=("again",)),
    ]
    plain = None
    for i, b in enumerate(batches):
        plain = store.upsert(plain, b)
        assert v.upsert(b).version == i
        assert rows(v.read()) == rows(plain)
    assert rows(v.read(0)) == rows(batches[0]) and v.versions() == [0, 1, 2, 3, 4]
    assert v.upsert(batches[0], incremental=False).version == 5 and rows(v.read()) == rows(batches[0])
    with pytest.raises(ValueError):
        v.upsert(batches[0].limit(0))


def test_a_batch_of_one_source_rewrites_one_bucket(spark, tmp_path):
    v = VersionedStore(spark, str(tmp_path), 16)
    before = v.upsert(chunks(spark, 0, *[f"s{i}.md" for i in range(40)]))
    after = v.upsert(chunks(spark, 1000, "s7.md"))
    changed = [b for b in before.files if before.files[b] != after.files[b]]
    assert len(before.files) > 8 and len(changed) == 1 and set(before.files) == set(after.files)
    gone = v.delete(store.Selector(source="s7.md", delete_all=True))
    assert [b for b in after.files if after.files[b] != gone.files.get(b)] == changed
    assert rows(v.read()) == rows(v.read(1).where("source <> 's7.md'"))
    assert v.vacuum(1) >= 1 and rows(v.read()) and v.versions() == [2]


def test_a_failed_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    v = VersionedStore(spark, str(tmp_path), 4)
    v.upsert(chunks(spark, 0, "a.md", "b.md"))
    was = rows(v.read())
    monkeypatch.setattr(v, "_create", lambda *_: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        v.upsert(chunks(spark, 10, "a.md", words=("x",)))
    assert rows(VersionedStore(spark, str(tmp_path)).read()) == was


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = VersionedStore(spark, str(tmp_path), 4), VersionedStore(spark, str(tmp_path), 4)
    base = one.upsert(chunks(spark, 0, "a.md"))
    won = one.upsert(chunks(spark, 10, "b.md"), base=base)
    with pytest.raises(CommitConflict):
        two.upsert(chunks(spark, 20, "c.md"), base=base)
    assert won.version == 1 and {r.source for r in two.read().collect()} == {"a.md", "b.md"}
    assert two.upsert(chunks(spark, 20, "c.md")).version == 2
    assert {r.source for r in one.read().collect()} == {"a.md", "b.md", "c.md"}
    # What the loser wrote is gone; each folder is named by a version.
    named = {f.split("/")[0] for x in one.versions() for f in one.manifest(x).files.values()}
    assert {p.name for p in (tmp_path / "data").iterdir()} == named
