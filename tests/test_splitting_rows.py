"""Splitting of records with null and shared ids, against records split one by one."""

from lodestream.operators.splitting import SplitConfig, breakpoints, split_record, split_records


def plain(rows, config):
    """(doc_id, source, tag, chunk_id, body) of records in order; every text here is a text of its own."""
    out = []
    for d, s, t, tag in rows:
        n = 0
        for body, *_ in split_record(t or "", None, config):
            if len(body.strip()) >= config.min_chunk_chars:
                out.append((d, s, tag, n, body))
                n += 1
    return sorted(out, key=repr)


def text(name, n):
    return f"# {name}\n" + "\n".join(f"The {name} sentence {i} says something of its own." for i in range(n))


def test_null_and_shared_ids(spark):
    rows = [
        (1, "a.md", text("alpha", 3), "x"), (None, "b.md", text("beta", 40), "y"), (1, "c.md", text("gamma", 60), None), (None, "d.md", text("delta", 2), "z"),
        (1, None, text("epsilon", 5), "x"), (2, "e.md", None, "x"), (3, "f.md", "", "x"), (4, "g.md", text("zeta", 30), "x"),
    ]
    config = SplitConfig(add_header=False)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tag string").repartition(4)
    got = sorted(((r.doc_id, r.source, r.tag, r.chunk_id, r.text) for r in split_records(df, config).collect()), key=repr)
    assert got == plain(rows, config)
    # A record with the text of an earlier one is left out, whatever its id.
    more = df.union(spark.createDataFrame([(9, "z.md", text("alpha", 3), "x")], df.schema))
    assert split_records(more, config).count() == len(got)
    assert split_records(df.limit(0)).collect() == []


def test_breakpoints():
    assert breakpoints([[1, 0], [1, 0], [0, 1], [0, 1]], 88.0) == {1}
    assert breakpoints([[1, 0]], 88.0) == set() and breakpoints([[0, 0], [0, 0]], 50.0) == {0}
