"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its path of tags from the root. For each path the length of
text and the punctuation of all its nodes are added up and divided by the number of nodes; both ratios
are smoothed over the nodes in page order, fused by their product, and the paths at or above a threshold
are content paths. The content lies in the smallest element that holds the nodes of these paths (an
article or main element above it, if there is one). Of that element blocks are kept, but for those whose
path is a list of links: a path of several blocks that hold links and nothing else.

Elements that say what they are not (nav, form, aside, a class or id such as "ad" or "comments") take no
part in the ratios and are not kept, unless that would leave nothing that reads like a paragraph: then the
one of them with the most of such text, say a form around the whole page, counts as unmarked, and so on
inwards. What is never shown (script, style, hidden elements) is never kept.

Defined results: null and empty pages give an empty text; a page of nothing but excluded nodes gives an
empty text; unclosed and misnested tags end with their parents; pages are independent of each other,
so ties, repeated rows, empty tables and further columns have no effect; time is linear in the page,
however deep it nests.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.buffers import giving_back
from lodestream.llm.text import text_or_empty
from lodestream.storage import bound_batches

#: Without backtracking, and a quote left open ends at the next tag, so time is linear in the page.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+)>""", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
#: Never shown as text, whatever is around them.
UNSEEN = frozenset("head script style noscript template textarea title iframe noembed noframes xmp svg canvas object datalist".split())
EXCLUDED = frozenset("nav footer aside form button select option input label fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
#: An opening tag ends an open element of these, if no element of BARRIER lies between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table select div section article main body".split())
#: Whole words of a class or id, and beginnings of such words, that mark what is no article text.
NAMES = frozenset(
    "ad ads adv adbox adsense dfp nav navbar topnav subnav sitenav menu topbar toolbar toc tags share sharing social login signup search widget alert "
    "toast rail side copyright legal discussion responses".split()
)
#: A name that says what an element has, not what it is, marks nothing: "has-sidebar", "no-ads".
HAS = ("has-", "has_", "with-", "with_", "no-", "no_", "without-", "not-", "is-", "hide-", "show-")
STARTS = ("advert", "sponsor", "promo", "banner", "cookie", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay", "newsletter",
          "subscri", "announce", "sidebar", "breadcrumb", "paginat", "comment", "disqus", "respond", "replies", "related", "recommend", "footer", "masthead",
          "navigation", "skip")
#: Elements that hold text, whose classes mostly speak of it; of these and of articles fewer names are believed.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th blockquote pre figure figcaption caption span a em strong b i u code q cite small mark".split())
TEXT_NAMES = frozenset("ad ads adv adbox adsense dfp share sharing social signup".split())
#: Words that may stand beside those in a name without changing what it says.
PARTS = frozenset(
    "area article bar block body bottom box btn button buttons card container content entry form google header inline inner item items js label left link links "
    "list main outer page panel post posts reader right section slot spot stories story text thread title top unit user wrap wrapper author count".split()
)
PUNCTUATION = re.compile(r"[.,;:!?\"'()\[\]…«»“”¡¿、。！，？]")
SMOOTH = (1.0, 2.0, 4.0, 2.0, 1.0)
#: A path is content if its fused value is this part of the greatest on the page, or more.
THRESHOLD = 0.1
#: Text of a node outside links that reads like a sentence, and how long is a paragraph.
SENTENCE, PARAGRAPH = re.compile(r"[.!?…](?:[\s\"')\]»”]|$)|[。！？]"), 60
#: Unmarked sentences that are this small a part of a page's paragraphs are too few to be its article.
LEAST_FREE = 0.03
#: A path of so many blocks of links alone is a menu.
LINK_BLOCKS = 3
SHOWN, MARKED, HIDDEN = 0, 1, 2


def _names_furniture(name: str, known: frozenset[str]) -> bool:
    """Whether a class or id as a whole names what is no article text: "ad-slot", but not "notice-period"."""
    words = [w for w in re.findall(r"[a-z]+", name) if len(w) > 1]
    told = [w in known or w.startswith(STARTS) for w in words]
    return any(told) and all(t or w in PARTS for w, t in zip(words, told, strict=True))


def _mark(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element announces itself as no article text, or as not shown."""
    mark = MARKED if tag in EXCLUDED or (tag == "header" and not in_article) else SHOWN
    if not attributes.strip() or tag in ("html", "body", "main"):
        return mark
    strict = in_article or tag in TEXTUAL or tag == "article"
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HIDDEN
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HIDDEN
        if name == "role" and value in ROLES:
            mark = MARKED
        if name == "class" and strict:
            known = TEXT_NAMES if tag in TEXTUAL or tag == "article" else NAMES
            mark = MARKED if any(_names_furniture(x, known) for x in value.split() if not x.startswith(HAS)) else mark
        elif name == "id" and strict:
            # Ids of headings and sections are made from their titles, so they say what the text is about.
            if tag in ("div", "ul", "ol", "section") and _names_furniture(value.strip(), NAMES) and (tag != "section" or "comment" in value):
                mark = MARKED
        elif name in ("class", "id"):
            words = [w for name_ in value.split() if not name_.startswith(HAS) for w in re.findall(r"[a-z]+", name_)]
            if any(w in NAMES or w.startswith(STARTS) for w in words) or (not in_article and "header" in words):
                mark = MARKED
    return mark


class Page:
    """Elements in the order they open, and text nodes outside those that are never shown."""

    def __init__(self, page: str) -> None:
        #: Of each element: tag, parent, its last descendant, path (a number) and mark; the first is the page.
        self.tag, self.parent, self.last, self.path, self.mark = [""], [-1], [0], [0], [SHOWN]
        #: (text, element, block) of each text node.
        self.nodes: list[tuple[str, int, int]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._read(page)

    def _read(self, page: str) -> None:
        tags, stack, nodes = self.tag, [0], self.nodes
        open_: Counter[str] = Counter()
        block, at, n, skip, articles = 0, 0, len(page), None, 0

        def pop_to(depth: int) -> None:
            nonlocal skip, articles
            for e in stack[depth:]:
                open_[tags[e]] -= 1
                articles -= tags[e] in ("article", "main")
                self.last[e] = len(tags) - 1
            del stack[depth:]
            if skip is not None and skip >= depth:
                skip = None

        def innermost(tag: str) -> int:
            depth = len(stack) - 1
            while tags[stack[depth]] != tag:
                depth -= 1
            return depth

        last_tag_ends = max(page.rfind(">"), page.rfind("<!--") + 1)  # a "<" after it opens nothing
        while at < n:
            lt = page.find("<", at)
            m = None
            while 0 <= lt < last_tag_ends and (m := TOKEN.match(page, lt) or LOOSE.match(page, lt)) is None:
                lt = page.find("<", lt + 1)
            stop = n if m is None else lt
            if stop > at and skip is None:
                nodes.append((html.unescape(page[at:stop]), stack[-1], block))
            if m is None:
                break
            at = m.end()
            if m[0].startswith("<![CDATA[") and skip is None:
                nodes.append((m[0][9:].removesuffix("]]>"), stack[-1], block))
            if m.lastindex is None or not m[2]:
                continue
            tag = m[2].lower()
            block += tag in BLOCKS
            if m[1]:
                if open_[tag]:
                    pop_to(innermost(tag))
                continue
            if tag == "br" and skip is None:
                nodes.append((" ", stack[-1], block))
            if tag in BLOCKS and open_["p"]:
                pop_to(innermost("p"))
            if tag in ENDS and any(open_[t] for t in ENDS[tag]):
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] in ENDS[tag]:
                        pop_to(depth)
                        if tag != "tr":
                            break
                    elif tags[stack[depth]] in BARRIER:
                        break
            if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path"):
                continue
            mark = HIDDEN if tag in UNSEEN else _mark(tag, m[3], articles > 0)
            if mark == HIDDEN and skip is None:
                skip = len(stack)
            self._open(tag, stack[-1], mark)
            open_[tag] += 1
            stack.append(len(tags) - 1)
            articles += tag in ("article", "main")
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                pop_to(len(stack) - 1)
        pop_to(0)

    def _open(self, tag: str, parent: int, mark: int) -> None:
        key = (self.path[parent], tag)
        self.path.append(self._paths.setdefault(key, len(self._paths) + 1))
        self.tag.append(tag)
        self.parent.append(parent)
        self.last.append(0)
        self.mark.append(mark)

    def _inherited(self, own: list[bool]) -> list[bool]:
        """For each element, whether it or one around it is so; parents come first."""
        for e in range(1, len(own)):
            own[e] = own[e] or own[self.parent[e]]
        return own

    def excluded(self) -> list[bool]:
        """For each element, whether its text is out, after marks that would leave no article are lifted."""
        size = len(self.tag)
        linked = self._inherited([t == "a" for t in self.tag])
        article = self._inherited([t in ("article", "main") and m == SHOWN for t, m in zip(self.tag, self.mark, strict=True)])
        # The marked element that keeps an element out, the innermost one; 0 for none. Inside each, marked ones wait.
        owner, inner = [0] * size, [[] for _ in range(size)]
        for e in range(1, size):
            owner[e] = owner[self.parent[e]] if self.mark[e] == SHOWN else e
            if self.mark[e] == MARKED:
                inner[owner[self.parent[e]]].append(e)
        held, free, named = [0] * size, [0] * size, [False] * size
        for text, e, _ in self.nodes:
            bare = text.strip()
            if article[e] or not linked[e] and (len(bare) >= PARAGRAPH or SENTENCE.search(bare)):
                free[owner[e]] += len(bare)
                named[owner[e]] |= article[e] and bool(bare)
                held[e] += len(bare) if article[e] or len(bare) >= PARAGRAPH else 0
        for e in range(size - 1, 0, -1):
            held[self.parent[e]] += held[e]
        outer = [(-held[e], e) for e in inner[0]]
        heapq.heapify(outer)
        so_far, seen = free[0], named[0]
        # Inwards, always into the outermost marked element that holds most; each is lifted once at most.
        while held[0] and not seen and so_far < LEAST_FREE * held[0] and outer:
            most, e = heapq.heappop(outer)
            if -most < LEAST_FREE * held[0]:
                break
            self.mark[e] = SHOWN
            so_far, seen = so_far + free[e], seen or named[e]
            for x in inner[e]:
                heapq.heappush(outer, (-held[x], x))
        return self._inherited([m != SHOWN for m in self.mark])


def content_paths(nodes: list[tuple[str, int]]) -> set[int]:
    """The paths at or above the threshold of smoothed, fused ratios; nodes are (text, path)."""
    nodes = [(bare, p) for t, p in nodes if (bare := t.strip())]
    length: dict[int, list[int]] = {}
    for bare, path in nodes:
        total = length.setdefault(path, [0, 0, 0])
        total[0] += len(bare)
        total[1] += len(PUNCTUATION.findall(bare))
        total[2] += 1
    if not nodes:
        return set()
    weights = np.array(SMOOTH) / sum(SMOOTH)
    ratios = []
    for k in (0, 1):
        row = np.array([(length[p][k] + k) / length[p][2] for _, p in nodes])
        ratios.append(np.convolve(np.pad(row, len(weights) // 2, mode="edge"), weights, mode="valid"))
    fused = ratios[0] * ratios[1]
    best: dict[int, float] = {}
    for (_, p), x in zip(nodes, fused.tolist(), strict=True):
        # Smoothing lifts a path by its neighbours; by its own ratios it must count for something, too.
        best[p] = max(best.get(p, 0.0), min(x, 8.0 * length[p][0] / length[p][2] * (length[p][1] + 1) / length[p][2]))
    least = THRESHOLD * max(best.values())
    return {p for p, x in best.items() if x >= least}


def _enclosing(page: Page, first: int, last: int) -> tuple[int, bool]:
    """The element whose blocks are kept, and whether it is one of the page's inner elements."""
    # Elements are numbered as they open, so what holds the first and the last hit holds all between.
    e = first
    while not e <= last <= page.last[e]:
        e = page.parent[e]
    up = e
    while up and page.tag[up] not in ("article", "main"):
        up = page.parent[up]
    if up:
        return up, True
    inside = page.parent[e] > 0 and page.tag[e] not in ("html", "body")
    while inside and page.parent[e] > 0 and page.tag[e] not in BLOCKS - {"p", "li", "ul", "ol"}:
        e = page.parent[e]
    return e, inside


def _menus(page: Page, blocks: dict[int, list[tuple[str, int]]], linked: list[bool]) -> set[int]:
    """Paths of blocks that hold links alone, each of which several blocks have."""
    links, other = Counter(), set()
    for nodes in blocks.values():
        inner = [(t, e) for t, e in nodes if t.strip()]
        if not inner:
            continue
        path = page.path[_block_of(page, inner[0][1])]
        if all(linked[e] for _, e in inner):
            links[path] += 1
        else:
            other.add(path)
    return {p for p, n in links.items() if n >= LINK_BLOCKS and p not in other}


def _block_of(page: Page, e: int) -> int:
    while e and page.tag[e] not in BLOCKS:
        e = page.parent[e]
    return e


def main_text(text: str) -> str:
    page = Page(text)
    out = page.excluded()
    nodes = [(t, e, b) for t, e, b in page.nodes if not out[e]]
    chosen = content_paths([(t, page.path[e]) for t, e, _ in nodes])
    hits = [i for i, (t, e, _) in enumerate(nodes) if page.path[e] in chosen and t.strip()]
    if not hits:
        return ""
    at = [nodes[i][1] for i in hits]
    around, inside = _enclosing(page, min(at), max(at))
    heading = page._inherited([t in HEADINGS for t in page.tag])
    first = hits[0]
    while first and nodes[first - 1][1] and (not nodes[first - 1][0].strip() or heading[nodes[first - 1][1]]):
        first -= 1
    blocks: dict[int, list[tuple[str, int]]] = {}
    for i, (t, e, block) in enumerate(nodes):
        if around <= e <= page.last[around] and (inside or first <= i <= hits[-1]):
            blocks.setdefault(block, []).append((t, e))
    linked = page._inherited([t == "a" for t in page.tag])
    # Inside an article a list of links is a part of it, such as its sources.
    menus = set() if page.tag[around] == "article" else _menus(page, blocks, linked)
    lines = []
    for part in blocks.values():
        line = " ".join("".join(t for t, _ in part).split())
        if line and not (menus and page.path[_block_of(page, next(e for t, e in part if t.strip()))] in menus):
            lines.append(line)
    return "\n".join(lines)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    bound_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", text_or_empty(F.col("html")).alias("html"))
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.mapInArrow(giving_back(run), f"{types}, text string, n_chars long")
