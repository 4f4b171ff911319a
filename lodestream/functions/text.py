"""Text functions as column expressions; nothing here leaves the JVM.

White space is what Python's ``str.split`` takes for it, which neither Java's ``\\s`` nor ``trim`` is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.scan import let, running_state

#: The white-space characters.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squash(c: Column, to: str = " ") -> Column:
    """Runs of white space become ``to``."""
    return F.regexp_replace(c, f"{_WS}+", to)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def words(c: Column) -> Column:
    return F.filter(F.split(squash(c), " "), lambda w: w != "")


def dedup_key(c: Column) -> Column:
    """Equal for texts that differ in white space and case only."""
    return F.lower(squash(blank(c), ""))


def compact_fragments(line: Column) -> Column:
    """Joins a line of four tokens or more if at least 60 % of them are single characters."""
    return _compacted(line, words(line))


def _compacted(line: Column, tokens: Column) -> Column:
    single = F.size(F.filter(tokens, lambda t: F.length(t) == 1))
    return F.when((F.size(tokens) >= 4) & (single / F.size(tokens) >= 0.6), F.array_join(tokens, "")).otherwise(line)


def _clean_lines(lines: Column) -> Column:
    """The lines to keep, noise left out.

    In steps, each an array of its own: what a lambda refers to twice would be computed twice.
    """
    steps = F.transform(lines, lambda raw: F.struct(strip(raw).alias("bare")))
    steps = F.transform(steps, lambda x: x.withField("line", squash(x["bare"])))
    steps = F.transform(steps, lambda x: x.withField("line", _compacted(x["line"], F.split(x["line"], " "))))
    steps = F.transform(steps, lambda x: x.withField("visible", F.replace(x["line"], F.lit(" "), F.lit(""))))
    steps = F.transform(steps, lambda x: x.withField("said", F.regexp_count(x["visible"], F.lit("[一-鿿A-Za-z0-9]"))))

    def keeps(x: Column) -> Column:
        size = F.length(x["visible"])
        noise = ((x["said"] == 0) & (size >= 3)) | ((x["said"] > 0) & (x["said"] / F.greatest(size, F.lit(1)) < 0.25))
        return (x["bare"] == "") | x["bare"].startswith("|") | ~noise

    return F.transform(F.filter(steps, keeps), lambda x: F.when(x["bare"].startswith("|"), x["bare"]).otherwise(x["line"]))


def clean_text(c: Column) -> Column:
    """Control characters and noise lines go; tables, headings and single blank lines stay."""
    t = F.regexp_replace(blank(c), "[\x00\ufeff\u200b]", "")
    t = F.regexp_replace(t, r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.array_join(_clean_lines(F.split(t, "\n")), "\n"), r"\n{3,}", "\n\n"))


def is_markdown(c: Column) -> Column:
    """Two heading lines or more."""
    return F.regexp_count(blank(c), F.lit(r"(?md)^#{1,6}\s+\S")) >= 2


#: Numbered headings and the level each gets.
NUMBERED_HEADINGS = (
    (r"^第[一二三四五六七八九十百0-9]+[章篇部](?:\s|$)", 1),
    (r"^第[一二三四五六七八九十百0-9]+[节条](?:\s|$)", 2),
    (r"^[一二三四五六七八九十]+\s*[、.．]", 2),
    (r"^[（(][一二三四五六七八九十]+[）)]", 3),
    (r"^\d+\.\d+\.\d+(?:[\s、.．]|$)", 4),
    (r"^\d+\.\d+(?:[\s、.．]|$)", 3),
)
#: List items, and the characters that end sentences in different rules.
LIST_ITEM = r"^\s*([-*•·]|\d+[.、）)])\s+"
TERMINAL = "。！？，；、!?,;…"
BOUNDARY = "。！？!?…；;："
PAGE_MARKER = r"^\[\[PAGE=\d+\]\]\s*$"
DATA_END = r"\d+(?:\.\d+)?\s*[a-zA-Z%‰°℃入万亿元件个条款]{0,6}$"
PAGE_NUMBER = r"^\s*(?:[-–—]\s*)?(?:第\s*)?\d{1,4}(?:\s*页)?(?:\s*/\s*\d{1,4})?(?:\s*[-–—])?\s*$"


def heading_level(line: Column, at_boundary: Column, next_line: Column) -> Column:
    """Level of the heading a line should become, or null."""
    bare = strip(line)
    last = F.substring(bare, -1, 1)
    possible = (
        F.length(bare).between(1, 40)
        & ~F.substring(bare, 1, 1).isin("#", "|")
        & ~bare.rlike(f"(?U){LIST_ITEM}")
        & ~last.isin(*TERMINAL)
    )
    short = (
        at_boundary
        & (F.length(bare) <= 20)
        & (F.size(words(bare)) <= 2)
        & (strip(blank(next_line)) != "")
        & ~bare.rlike("[。，；：,;:]")
        & ~bare.rlike(r"(?U)^[\d\s.%-]+\z")
    )
    level = F.when(~possible, None)
    for pattern, n in NUMBERED_HEADINGS:
        level = level.when(bare.rlike(f"(?U){pattern}"), n)
    return level.when(short, 2)


def promote_headings(c: Column) -> Column:
    """Heading lines of a text without Markdown headings get their marks.

    Whether a line is a heading depends on what the line before became: a machine of two states.
    """
    lines = F.split(c, "\n")

    def bounds(x: Column) -> Column:
        bare = strip(x)
        return x.rlike(PAGE_MARKER) | (bare == "") | F.substring(bare, -1, 1).isin(*BOUNDARY) | bare.rlike(f"(?U){DATA_END}")

    def marked(lines: Column) -> Column:
        def level(x: Column, i: Column, boundary: bool) -> Column:
            below = F.coalesce(F.get(lines, i + 1), F.lit(""))
            return F.when(~x.rlike(PAGE_MARKER), heading_level(x, F.lit(boundary), below))

        def facts(x: Column, i: Column) -> Column:
            return F.struct(x.alias("x"), level(x, i, False).alias("f"), level(x, i, True).alias("t"), bounds(x).alias("e"))

        return let(F.transform(lines, facts), lambda rows: F.array_join(F.zip_with(rows, before(rows), written), "\n"))

    def before(rows: Column) -> Column:
        after = [F.transform(rows, lambda r: r["e"] | r["f"].isNotNull()), F.transform(rows, lambda r: r["e"] | r["t"].isNotNull())]
        return F.concat(F.array(F.lit(True)), F.slice(running_state(*after, True), F.lit(1), F.size(rows) - 1))

    def written(r: Column, boundary: Column) -> Column:
        v = F.when(boundary, r["t"]).otherwise(r["f"])
        return F.when(v.isNotNull(), F.concat(F.repeat(F.lit("#"), v), F.lit(" "), strip(r["x"]))).otherwise(r["x"])

    return F.when((c == "") | is_markdown(c), c).otherwise(let(lines, marked))


def unwrap_lines(c: Column) -> Column:
    """Joins a line to the one before if that was cut at the page's width: 30 characters or more, no end
    of sentence, neither of the two a table, page marker, heading or list item.

    What was joined is long enough and begins as it did, so a machine of two states (joined or not) decides.
    """
    lines = F.split(c, "\n")

    def runs_on(x: Column) -> Column:
        return ~F.substring(strip(x), -1, 1).isin(*BOUNDARY)

    def open_(x: Column) -> Column:
        bare = strip(x)
        return (F.length(bare) >= 30) & runs_on(x) & ~bare.startswith("|") & ~bare.rlike(PAGE_MARKER)

    def goes_on(x: Column) -> Column:
        bare = strip(x)
        return (bare != "") & ~F.substring(bare, 1, 1).isin("#", "|") & ~bare.rlike(PAGE_MARKER) & ~bare.rlike(f"(?U){LIST_ITEM}")

    def facts(x: Column) -> Column:
        return F.struct(x.alias("x"), goes_on(x).alias("on"), open_(x).alias("open"), runs_on(x).alias("runs"))

    def behind(rows: Column, test: str) -> Column:
        return F.transform(rows, lambda r, i: F.when(i > 0, r["on"] & F.get(rows, i - 1)[test]).otherwise(False))

    def put_together(rows: Column, joined: Column) -> Column:
        def piece(r: Column, i: Column) -> Column:
            on, more = F.get(joined, i), F.coalesce(F.get(joined, i + 1), F.lit(False))
            body = F.when(on, strip(r["x"])).when(more, F.regexp_replace(r["x"], rf"{_WS}+\z", "")).otherwise(r["x"])
            return F.concat(F.when(on, "").otherwise("\n"), body)

        return F.substring(F.array_join(F.transform(rows, piece), ""), 2, (1 << 31) - 1)

    def all_lines(rows: Column) -> Column:
        return let(running_state(behind(rows, "open"), behind(rows, "runs"), False), lambda joined: put_together(rows, joined))

    return let(F.transform(lines, facts), all_lines)


def render_table(rows: Column) -> Column:
    """Markdown of an array of rows of cells: white space squashed, empty rows dropped, short ones padded."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda x: strip(squash(blank(x)))))
    full = F.filter(clean, lambda r: F.exists(r, lambda x: x != ""))
    width = F.array_max(F.transform(full, lambda r: F.size(r)))
    line = F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    return F.when(F.size(full) <= 0, "").otherwise(F.array_join(F.concat(F.slice(line, 1, 1), F.array(rule), F.slice(line, 2, F.greatest(F.size(line), F.lit(1)))), "\n"))


def strip_intent_suffix(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)\s*<INTENT>.*?</INTENT>\s*\z", ""))


def document_title(source: Column) -> Column:
    """File name without its extension, underscores as blanks."""
    stem = F.regexp_replace(F.element_at(F.split(F.replace(blank(source), F.lit("\\"), F.lit("/")), "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return strip(F.replace(stem, F.lit("_"), F.lit(" ")))


def context_header(title: Column, path: Column) -> Column:
    """The chapter line of a chunk: title and path, a part left out if it repeats the crumb before."""
    start = F.when(title != "", F.array(title)).otherwise(F.array().cast("array<string>"))

    def step(acc: Column, part: Column) -> Column:
        again = (F.size(acc) > 0) & (dedup_key(F.element_at(acc, -1)) == dedup_key(part))
        return F.when(F.size(acc) == 0, F.array(part)).when(again, acc).otherwise(F.concat(acc, F.array(part)))

    crumbs = F.aggregate(path, start, step)
    return F.when(F.size(crumbs) == 0, "").otherwise(F.concat(F.lit("【所属章节】"), F.array_join(crumbs, " > ")))


def state_file_name(key: Column) -> Column:
    """A safe file name for a visitor; long ones are cut and get part of their SHA-256."""
    raw = strip(blank(key))
    safe = F.regexp_replace(raw, r"(?U)[^\w\-.]", "_")
    short = F.concat(F.substring(safe, 1, 80), F.lit("_"), F.substring(F.sha2(raw.cast("binary"), 256), 1, 16))
    return F.when(raw == "", "anonymous.json").otherwise(F.concat(F.when(F.length(safe) > 120, short).otherwise(safe), F.lit(".json")))


def ask_text(c: Column, limit: int = 120) -> Column:
    """A question put to a visitor, as kept: intent marks out, white space squashed, cut to ``limit``."""
    return F.substring(squash(strip(F.regexp_replace(blank(c), r"(?is)<INTENT>.*?</INTENT>", ""))), 1, limit)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"""[<>:"/\\|?*\x00-\x1f]""", "_")


def safe_tag(c: Column, default: str = "general") -> Column:
    name = safe_name(strip(blank(c)))
    return F.when((name == "") | name.contains(".."), default).otherwise(name)


def is_safe_path(c: Column) -> Column:
    """Neither empty, absolute nor leading upwards."""
    p = F.replace(strip(blank(c)), F.lit("\\"), F.lit("/"))
    return (p != "") & ~p.startswith("/") & ~p.rlike(r"(^|/)\.\.(/|$)") & ~p.rlike(r"^[A-Za-z]:")


def is_plain_key(c: Column) -> Column:
    return ~c.rlike(r"[/\\]") & ~c.contains("..") & (strip(c) != "")


def display_name(tag: Column, names: Column) -> Column:
    key = F.lower(strip(blank(tag)))
    return F.coalesce(F.element_at(names, key), F.upper(key))


def iso_seconds(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch.try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss")


def rewrite_tags(c: Column, names: dict[str, str]) -> Column:
    """Tags that stand alone are replaced by their display names, any case."""
    for tag, name in names.items():
        c = F.regexp_replace(c, rf"(?i)(?<![a-zA-Z0-9])\Q{tag}\E(?![a-zA-Z0-9])", name.replace("\\", r"\\").replace("$", r"\$"))
    return c


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def size_label(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
    )


def source_key(c: Column, root: str = "") -> Column:
    """A source key as compared: slashes forward, the root and any leading run of dots and slashes off."""
    k = F.replace(strip(blank(c)), F.lit("\\"), F.lit("/"))
    if root:
        k = F.when(k.startswith(root.rstrip("/") + "/"), F.substring(k, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(k)
    return F.when(k.startswith("/"), k).otherwise(F.regexp_replace(k, r"^[./]+", ""))


def source_key_variants(c: Column, root: str) -> Column:
    key = source_key(c, root)
    full = F.when(key.startswith("/"), key).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), key))
    return F.filter(F.array_distinct(F.array(c, key, full)), lambda x: x != "")


def first_directory(relpath: Column, default: str = "general") -> Column:
    parts = F.split(relpath, "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(default)


def mirror_path(source: Column, data_root: str) -> Column:
    """Where a source's metadata lies: its path below the data root, or its name, as .json."""
    key, root = source_key(source), data_root.strip("/") + "/"
    rel = F.when(key.startswith(root), F.substring(key, len(root) + 1, 1 << 30)).otherwise(F.element_at(F.split(key, "/"), -1))
    return F.concat(F.regexp_replace(rel, r"(?<=[^/])\.[^./]+$", ""), F.lit(".json"))


def json_stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.json$", "")


SENTENCE = r"(?<=[。！？!?；;])\s*"
SPLIT_ITEM = r"^\s*([-*•·]|\d+[.、）)]|[（(]?[一二三四五六七八九十]+[）)、.])\s+"


def sentences(c: Column) -> Column:
    """Sentences of each line in order; list items, tables and marked lines stay whole."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")

    def cut(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(line, SENTENCE), strip), lambda p: p != "")
        whole = line.rlike(f"(?U){SPLIT_ITEM}") | line.startswith("|") | line.startswith("◆")
        return F.when(whole | (F.size(parts) == 0), F.array(line)).otherwise(parts)

    return F.flatten(F.transform(lines, cut))
