"""Secret scans. DataFrame functions only, and no shuffle: each text is scanned where it is read.

Three pattern kinds (assign, access, hex) and one statistical kind (entropy). The last takes
candidate strings of 20 characters or more, slides a window of 20 over each, and keeps the Shannon
entropy of the window up to date by raising the count of the character that enters and lowering the
count of the one that leaves. A candidate is flagged if a window reaches the threshold of its
character class and the allow-list does not have it: patterns that match it whole, and candidates made of
words, of whose neighbouring letters a third or more are pairs that are common in languages.

Defined results: a null text counts as empty and has no spans; offsets are code points, ends
exclusive; rows are independent, so ties, repeats, empty tables and further columns have no effect.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.scan import let, running
from lodestream.llm.text import text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: (kind, pattern, group whose length counts, least length), in the order that breaks ties of start.
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
#: Patterns that no text without them can satisfy; other texts are passed by at once.
HINT = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least entropy in bits of a window, by character class. log2(20) is the most a window can have.
THRESHOLDS = {"hex": 3.05, "alnum": 3.4, "mixed": 3.6}
#: Whole candidates that are no secrets: UUIDs; dates, times and numbers. Character classes only, so no text makes
#: them backtrack.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9TZ/_=+-]+",
)
#: Frequent pairs of letters in words of English, German, French and Spanish. Of random letters they are one pair in six.
COMMON_PAIRS = tuple(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
    "el la ta ec us un ie ge au sc em di ei ut ns ss pa lo ad ac ue qu do os ai ir po pr tr wh ho wa sh so fo ca mo no il ol ot et ee id ig am "
    "oi eu ux".split()
)
#: A candidate with this part of its letter pairs among them is made of words; of fewer pairs nothing is said.
WORDS_SHARE, LEAST_PAIRS = 1 / 3, 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _placed(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches, and the pieces of text between them; their lengths give the offsets."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _spans(matches: Column, between: Column, kind: int) -> Column:
    """Array of (start, kind, end, match), by running sums of the lengths of pieces and matches."""
    ends = running(F.zip_with(between, matches, lambda a, b: F.length(a) + F.length(b)), lambda a, b: a + b, F.lit(0))
    return F.zip_with(
        ends,
        matches,
        lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("match")),
    )


def char_class(s: Column) -> Column:
    return F.when(s.rlike("^[0-9a-fA-F]+$"), "hex").when(s.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("mixed")


def max_window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Greatest Shannon entropy, in bits, of any ``window`` characters in a row of ``s``.

    sum(c * log2 c) over the counts c is kept as a running value: each step adds the change made by
    one count going up and one going down. The entropy is log2(n) less that sum over n.
    """
    plogp = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    shape = "struct<counts:array<int>,sum:double,least:double,n:int>"
    none = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
    first = F.struct(none.alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"), F.lit(0).alias("n")).cast(shape)
    # Characters by number, once; each then meets the one that leaves the window as it enters.
    new = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    gone = F.slice(F.concat(F.array_repeat(F.lit(-1), window), new), F.lit(1), F.length(s))

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        up = F.get(acc["counts"], new)
        grown = F.transform(acc["counts"], lambda c, j: c + F.when(j == new, 1).otherwise(0))
        down = F.when(old >= 0, F.get(grown, old)).otherwise(0)
        total = acc["sum"] + F.get(plogp, up + 1) - F.get(plogp, up) + F.get(plogp, F.greatest(down - 1, F.lit(0))) - F.get(plogp, down)
        counts = F.transform(grown, lambda c, j: c - F.when(j == old, 1).otherwise(0))
        n = acc["n"] + 1
        least = F.when(n >= window, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(counts.alias("counts"), total.alias("sum"), least.alias("least"), n.alias("n")).cast(shape)

    pairs = F.zip_with(new, gone, lambda a, b: F.struct(a.alias("new"), b.alias("old")))
    return F.aggregate(pairs, first, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)


def is_words(s: Column) -> Column:
    """Whether a candidate's neighbouring letters are those of words."""

    def judged(chars: Column) -> Column:
        pairs = F.filter(F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1))), lambda p: p.rlike("^[a-z]{2}$"))
        return let(pairs, lambda ps: (F.size(ps) >= LEAST_PAIRS) & (F.size(F.filter(ps, lambda p: p.isin(*COMMON_PAIRS))) >= WORDS_SHARE * F.size(ps)))

    return let(F.split(F.lower(s), ""), judged)


def is_secretlike(s: Column) -> Column:
    limit = F.create_map(*[x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))])
    allowed = F.lit(False)
    for p in ALLOW:
        allowed = allowed | s.rlike(f"^(?:{p})$")
    return ~allowed & ~is_words(s) & (max_window_entropy(s) >= F.element_at(limit, char_class(s)))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found): spans as (start, kind, end, match), kinds numbered as in BASE, 3 for entropy."""
    t = F.col("t")
    none_m, none_p = F.array().cast("array<string>"), F.array().cast("array<string>")
    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("t"))
    patterns = [(k, p, HINT[k]) for k, p, _, _ in BASE] + [("entropy", CANDIDATE, CANDIDATE)]
    for k, p, hint in patterns:
        m, between = _placed(t, p)
        rows = rows.withColumn(f"m_{k}", F.when(t.rlike(hint), m).otherwise(none_m))
        rows = rows.withColumn(f"b_{k}", F.when(F.size(f"m_{k}") > 0, F.slice(between, F.lit(1), F.size(f"m_{k}"))).otherwise(none_p))
    rows = rows.drop("t")
    for n, (k, _, _) in enumerate(patterns):
        rows = rows.withColumn(f"s_{k}", _spans(F.col(f"m_{k}"), F.col(f"b_{k}"), n)).drop(f"m_{k}", f"b_{k}")

    def long_enough(k: str, pattern: str, group: int, least: int) -> Column:
        part = (lambda x: x["match"]) if group == 0 else (lambda x: F.regexp_extract(x["match"], pattern, group))
        return F.filter(f"s_{k}", lambda x: F.length(part(x)) >= least)

    base = F.concat(*[long_enough(*b) for b in BASE])
    found = F.filter("s_entropy", lambda x: is_secretlike(x["match"]))
    return rows.select("doc_id", F.array_sort(base).alias("base"), found.alias("found"))


def secrets_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: see the module's text."""
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("entropy"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

    hits = scan_secrets(docs)
    # A function of its own: a second parameter of the lambda would be taken for the index.
    def count_of(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [count_of(n).alias(f"n_{k}") for n, (k, *_) in enumerate(BASE)]
    return hits.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "found"))).alias("spans"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for ``secrets_report``: matches and the pieces between them give the offsets there, too."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    kinds = [(k, p) for k, p, _, _ in BASE] + [("entropy", CANDIDATE)]
    placed = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS kind, '{k}' AS name, regexp_extract_all(t, {quoted(p)}) AS ms, regexp_split_to_array(t, {quoted(p)}) AS ps FROM d"
        for n, (k, p) in enumerate(kinds)
    )
    measured = "length(CASE kind WHEN 0 THEN regexp_extract(m, " + quoted(ASSIGN) + ", 2) ELSE m END) >= CASE kind "
    measured += " ".join(f"WHEN {n} THEN {least}" for n, (_, _, _, least) in enumerate(BASE)) + " ELSE 0 END"
    allowed = " OR ".join(f"regexp_full_match(m, {quoted(p)})" for p in ALLOW)
    pairs = "list_filter(list_transform(range(1, length(m)), lambda i: substr(lower(m), i, 2)), lambda p: regexp_full_match(p, '[a-z]{2}'))"
    common = ", ".join(f"'{x}'" for x in COMMON_PAIRS)
    words = f"len({pairs}) >= {LEAST_PAIRS} AND len(list_filter({pairs}, lambda p: p IN ({common}))) >= CAST({WORDS_SHARE!r} AS DOUBLE) * len({pairs})"
    limit = f"CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN {THRESHOLDS['hex']} WHEN regexp_full_match(m, '[A-Za-z0-9]+') THEN {THRESHOLDS['alnum']} ELSE {THRESHOLDS['mixed']} END"
    windows = f"list_max(list_transform(range(1, length(m) - {WINDOW - 2}), lambda i: list_aggregate(string_split(substr(m, i, {WINDOW}), ''), 'entropy')))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({placed}),
e AS (SELECT doc_id, kind, name, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM p WHERE len(ms) > 0),
s AS (SELECT doc_id, kind, name, ms[i] AS m, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM e),
k AS (SELECT doc_id, kind, pos, name || ':' || pos || ':' || (pos + length(m)) AS span FROM s
      WHERE {measured} AND (kind < 3 OR NOT ({allowed}) AND NOT ({words}) AND {windows} >= {limit})),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      string_agg(span, ',' ORDER BY pos, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY pos, kind) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
