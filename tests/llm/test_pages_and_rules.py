"""HTML extraction and quality rules, against plain versions."""

import html
import random
import re
import time
import timeit
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestream.llm.html_extract import Page, content_paths, extract_pages, main_text
from lodestream.llm.quality_rules import _analyse, quality_report, strip_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pages_give_their_articles(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r for r in extract_pages(df).collect()}
    rows = df.collect()
    assert len(out) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
        assert out[r.page_id].text == "\n".join(b for b in blocks if b)
        assert out[r.page_id].n_chars == len(out[r.page_id].text) and out[r.page_id].url == r.url


def test_what_is_no_article_goes():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site, name.</h1></header>
    <div class="cookie-notice"><p>We use cookies, as all do. Agree?</p></div><ul class="main-menu"><li><a href="x">Home</a></ul>
    <div id="main-content"><h2>Title &amp; more</h2><p>Some long text, with marks. More of it,
      here.</p><div class="ad-slot">Buy, now!</div><ul><li>Item one<li>Item <i>two</i></ul><script>if (a<b) "</p>";</script><p>Next para&nbsp;with <a href="x>y">a link</a> and 3 < 4.
    <form><p>Subscribe, please.</p></form></div><aside><p>Side text, that is long. Really, it is.</p></aside>
    <section id="comments"><p>Nice post, thanks! I liked it, really.</p></section><div hidden>Hidden, text.</div><footer>c</footer></body></html>"""
    assert main_text(page) == "Title & more\nSome long text, with marks. More of it, here.\nItem one\nItem two\nNext para with a link and 3 < 4."


def test_names_of_what_an_element_has():
    body = "<p>Some text, long enough. And more, of it.</p>"
    assert main_text(f'<div class="page has-sidebar no-ads">{body}<div class="right-rail"><p>Aside, text.</p></div></div>') == "Some text, long enough. And more, of it."
    assert main_text(f'<div class="menu-page"><article>{body}</article></div>') == "Some text, long enough. And more, of it."
    assert main_text('<div class="ad"><p>Buy, now. All of it.</p></div>') == ""


SENTENCES = "The fox, which lives here, jumps over the lazy dog. Again and again, it does. "
ARTICLE = "<h1>Title of it</h1>" + f"<p>{SENTENCES * 3}</p>" * 4
LINES = ["Title of it", *[(SENTENCES * 3).strip()] * 4]
MENU = "<ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li><li><a href=3>Contact</a></li></ul>"
REPLIES = f'<div class="comments"><p>{SENTENCES.replace("fox", "cat")}</p></div>'


def test_marks_around_the_article_are_lifted():
    for page in (
        f'<body><form id="aspnetForm">{MENU}<article>{ARTICLE}</article></form></body>',
        f'<body><form id="aspnetForm">{MENU}<div>{ARTICLE}</div>{REPLIES * 9}</form></body>',
        f'<body>{MENU}<div class="post comments-open">{ARTICLE}{REPLIES}</div></body>',
        f'<nav>{MENU}</nav><div id="content" class="layout-side">{ARTICLE}</div><div class=sidebar><p>{SENTENCES}</p></div>',
        f'<form><div class="menu-page"><div class="has-share ad-free-toc">{ARTICLE}</div></div></form>',
        f"<body><div id=c>{MENU}{ARTICLE}</div></body>",
    ):
        assert main_text(page).split("\n") == LINES, page[:80]
    assert main_text(f"<article>{ARTICLE}<p>We have <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here, so.</p></article>").split("\n") == [*LINES, "We have x=1 here, so."]
    assert main_text(f"<div><p>{SENTENCES}</p></div>{REPLIES * 20}") == SENTENCES.strip()


def test_pages_without_article_tags(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        assert main_text(r.html.replace("<article", "<div").replace("</article", "</div")) == main_text(r.html)


def plain_paths(nodes):
    """Content paths straight from their definition, path by path and place by place."""
    kept = [(t.strip(), p) for t, p in nodes if t.strip()]
    ratio = {}
    for p in {p for _, p in kept}:
        own = [t for t, q in kept if q == p]
        marks = sum(len(re.findall(r"[.,;:!?\"'()\[\]…«»“”¡¿、。！，？]", t)) for t in own)
        ratio[p] = (sum(map(len, own)) / len(own), (marks + 1) / len(own))
    weight, best = [0.1, 0.2, 0.4, 0.2, 0.1], {}
    for i, (_, p) in enumerate(kept):
        near = [ratio[kept[min(max(i + k - 2, 0), len(kept) - 1)][1]] for k in range(5)]
        x = sum(w * r[0] for w, r in zip(weight, near)) * sum(w * r[1] for w, r in zip(weight, near))
        best[p] = max(best.get(p, 0), min(x, 8 * ratio[p][0] * ratio[p][1]))
    return {p for p, x in best.items() if x >= 0.1 * max(best.values())}


def test_content_paths(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        page = Page(r.html)
        nodes = [(t, page.path[e]) for t, e, _ in page.nodes]
        assert content_paths(nodes) == plain_paths(nodes)


def test_deep_pages_in_linear_time():
    deep = {n: "<div><span>" * n + ARTICLE + "</span></div>" * n for n in (1, 20_000, 80_000)}
    assert main_text(deep[1]).split("\n") == main_text(deep[80_000]).split("\n") == LINES
    small, large = (min(timeit.repeat(lambda: main_text(deep[n]), number=1, repeat=2)) for n in (20_000, 80_000))
    assert large < 8 * small + 0.5


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain text, no markup."), (4, "u", "<p>a<p>b"), (5, "u", "<nav><p>only, a menu.</p></nav>"), (6, "u", "<script>never closed"),
            (None, "u", "<div><p>one, two.</p></div></div></p>"), (7, "u", "<article>" + "<p>word, word. &eacute;</p>" * 3000 + "</article>"), (8, "u", "<!-- open"), (9, "u", "<a b='")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert out[1] == out[2] == out[5] == out[6] == out[8] == ""
    assert out[3] == "plain text, no markup." and out[4] == "a\nb" and out[None] == "one, two." and out[7].count("\n") == 2999
    assert extract_pages(df.limit(0)).collect() == []


def plain_report(rows):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    norm = lambda line: " ".join(WORD.findall(low(line)))
    held, hosts = defaultdict(int), Counter(s for _, _, s in rows)
    for _, t, s in rows:
        for h in {norm(x) for x in (t or "").split("\n")} - {""}:
            held[s, h] += 1
    often = {k for k, n in held.items() if n > 10 and (n * 100 > hosts[k[0]] or n > 1000)}
    out = []
    for d, t, s in rows:
        t = t or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = Counter(wins)
        hit = {i + k for i, w in enumerate(wins) if count[w] > 1 for k in range(3)}
        removed = sum(len(WORD.findall(x)) for x in lines if (s, norm(x)) in often)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        out.append((d, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), removed, failed, not failed and 2 * removed <= len(words)))
    return sorted(out, key=repr)


def test_quality_rules(spark):
    many = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Shared  line here {many if i % 2 else ''}\n" + ("same LINE\n" * (i % 3)) + " ".join(f"x{i}y{j}" for j in range(55)), "h") for i in range(30)]
    rows += [(100, None, None), (101, "", "h"), (102, "\n\n", None), (103, "a b c " * 30, "h"), (104, "é😀 # $\x0b% " * 20, "z"), (105, "ends\n", "h"), (106, "\nstarts", "h"),
             (None, "no id " + many, "h"), (1, rows[1][1], "h"), (107, "long " + " ".join(f"q{i}" for i in range(60_000)), "h"), (108, "\n".join(["dup line one", "dup line one", " dup line one"] * 9), "h")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, uid int, lines string")
    out = [tuple(r) for r in quality_report(df).collect()]
    assert sorted(out, key=repr) == plain_report(rows)
    assert any(r[-3] for r in out) and quality_report(df.limit(0)).collect() == []


def test_boilerplate_lines_are_removed(spark):
    body = lambda i: " ".join(f"x{i}y{j}" for j in range(55))
    rows = [(i, f"Shared  LINE\n{body(i)}\nshared line", "h", 1) for i in range(30)] + [(50, f"shared line\n{body(50)}", None, 1), (51, "shared line\n" * 80, "h", 1), (52, None, "h", 1)]
    rows += [(100 + i, f"top\n{body(i)}", "big", 1) for i in range(1001)] + [(5000 + i, body(5000 + i), "big", 1) for i in range(150_000 // 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    out = {r.doc_id: r for r in strip_lines(df).collect()}
    assert strip_lines(df).columns == df.columns and set(out) == {r[0] for r in rows} - {51, 52}
    assert all(out[i].text == body(i) and out[i].n_chars == len(body(i)) for i in range(30))
    assert out[50].text == rows[30][1] and out[100].text == body(0) and out[5000].text == body(5000)


def test_many_distinct_words_do_not_collide():
    words = [f"{i:x}" for i in range(1 << 22)]
    text = " ".join([*words, words[5], words[7], words[9], words[5 + (1 << 20)], words[7], words[9]]).encode()
    stats, _ = _analyse(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    assert stats["n_words"][0] == (1 << 22) + 6 and stats["n_repeat_words"][0] == 0


WORDS = "A sentence of some length, that an article would have. It goes on, and ends."


def article(inside, before="", after=""):
    return f"<html><body><nav><a href='/'>Home</a></nav>{before}<article><h1>Title</h1><p>{WORDS}</p>{inside}</article>{after}<footer>c</footer></body></html>"


@pytest.mark.parametrize(
    "inside, kept",
    [
        ('<h2 id="related-work">Related work</h2><p>Others did it, too.</p>', "Related work\nOthers did it, too."),
        ('<section id="discussion"><h2>Discussion</h2><p>It was long.</p></section>', "Discussion\nIt was long."),
        ('<p class="notice-period">A notice period, of weeks.</p><p class="side effects">Side effects are few.</p>', "A notice period, of weeks.\nSide effects are few."),
        ('<h2>Sources</h2><ul><li><a href="1">One</a></li><li><a href="2">Two</a></li><li><a href="3">Three</a></li></ul>', "Sources\nOne\nTwo\nThree"),
        ('<div class="share-price"><p>The share price rose.</p></div><div id="search-algorithms"><p>Search is old.</p></div>', "The share price rose.\nSearch is old."),
        ('<div class="ad-slot">Buy now!</div><div class="related-posts"><a href="x">More</a></div><ul class="share-buttons"><li>Share</li></ul><p class="advert">Buy.</p>', ""),
        ('<div class="comments"><p>Nice post, I liked it.</p></div><section id="comments"><p>Me, too, as ever.</p></section>', ""),
    ],
)
def test_only_what_is_no_article_goes(inside, kept):
    assert main_text(article(inside)) == "\n".join(x for x in ("Title", WORDS, kept) if x)


def test_comments_that_are_articles_go():
    comments = "".join(f'<article class="comment"><p>{WORDS} Says reader {i}, who has read it.</p></article>' for i in range(5))
    page = f"<html><body><main><h1>Title</h1><p>{WORDS}</p><p>{WORDS}</p>{comments}</main></body></html>"
    assert main_text(page) == f"Title\n{WORDS}\n{WORDS}"
    assert main_text(article("", after=f"<div class='thread'>{comments}</div>")) == f"Title\n{WORDS}"


def test_nested_marks_in_linear_time():
    def seconds(n):
        page = '<div class="ad">' * n + f"<p>{WORDS}</p>" + "</div>" * n
        began = time.perf_counter()
        assert main_text(page) == WORDS
        return time.perf_counter() - began

    seconds(500)
    assert seconds(8000) < 12 * max(seconds(2000), 0.02)


def plain_lines(page):
    """The lines of the article of a page of simple elements: each p, h1, h2 and li inside <article> that has no marked element around it."""
    out, at, depth, skip = [], 0, 0, None
    for m in re.finditer(r"<(/?)(\w+)([^>]*)>([^<]*)", page):
        close, tag, attrs, text = m.groups()
        if tag == "article":
            at += -1 if close else 1
        if tag in ("div", "nav", "aside"):
            depth += -1 if close else 1
            if not close and skip is None and (tag != "div" or 'class="ad"' in attrs):
                skip = depth
            elif close and skip is not None and depth < skip:
                skip = None
        if at and skip is None and not close and tag in ("p", "h1", "h2", "li") and text.strip():
            out.append(" ".join(text.split()))
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(20))
def test_random_pages_against_a_plain_reading(seed):
    rng = random.Random(seed)

    def blocks(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["p", "p", "p", "h2", "list", "div", "ad", "aside"])
            if kind in ("p", "h2"):
                out.append(f"<{kind}>{rng.choice(['Some', 'Other', 'More'])} text {rng.random()}, with marks. {WORDS}</{kind}>")
            elif kind == "list":
                out.append("<ul>" + "".join(f"<li>Item {rng.random()}, one. {WORDS}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif depth < 3:
                open_, close = {"div": ("<div>", "</div>"), "ad": ('<div class="ad">', "</div>"), "aside": ("<aside>", "</aside>")}[kind]
                out.append(open_ + "".join(blocks(depth + 1)) + close)
        return out

    page = f"<html><body><nav><ul><li>Home</li></ul></nav><article><h1>Title of it</h1><p>{WORDS}</p>{''.join(blocks(0))}</article><aside><p>{WORDS}</p></aside></body></html>"
    assert main_text(page) == plain_lines(page)
