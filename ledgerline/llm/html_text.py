"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path (a class marks a
path of its own). For every path two ratios are taken over its nodes: text
length per node and punctuation per node. Both are smoothed over neighbouring
nodes in page order and fused (length ratio times one plus punctuation ratio).
A path's mean is compared with a threshold, ``THRESHOLD`` times the mean of all
nodes; the nodes of paths at or above it are the content.

If most of the content stands in `article` or `main` elements, the outermost one
with most of it is the container; of several articles inside it that one alone
counts that has most of the container's content, if one has. Else the container
is the lowest sectioning element around all content nodes and the headings close
before one of them; without one, and where that is the body, it is the page from
the first to the last of these nodes. All blocks of the container are the text,
in page order, however short they are.

Paths through menus, headers of the page, footers, sidebars, notices, adverts,
forms, comments and code never count: by element (`nav`, `aside`, `form`, ...),
by the attribute `hidden`, or by a class, id or role that names them as a whole.
Such a name does not count on a heading or an outer `article`, as an id it does
not count on a paragraph, and it does not count on an element with most of the
text if no article or main stands outside it. Blocks made of links only do not
choose the container; inside it they are text.

A page is read in one pass with parent links, so its cost grows with its length,
whatever its nesting. What a cut-off page leaves of an open tag is dropped.

Defined results: null or empty html, or html without such text, gives an empty
string; character references are decoded; white space inside a block becomes
one space, blocks are joined by one space; broken nesting is mended as browsers
do (a new paragraph ends an open one). Null ids, null URLs and repeated rows
are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table

THRESHOLD = 0.25
SMOOTH = (0.1, 0.2, 0.4, 0.2, 0.1)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
                    r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: A tag whose quotes do not match ends at the next `>`.
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_OPEN_TAG = re.compile(r"</?(?:[A-Za-z]|\Z)")
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_PUNCT = re.compile(r"[.,;:!?…。、，！？；：¿¡]")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
          "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
          "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br", "hr"}
_SECTION = {"article", "body", "div", "html", "main", "section", "td"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_OUT = {"aside", "datalist", "dialog", "fieldset", "footer", "form", "head", "input", "menu", "nav", "option", "select"}
_OUT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs",
              "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disclaimer",
              "disqus", "footer", "gdpr", "masthead", "menu", "menubar", "modal", "nav", "navbar",
              "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo",
              "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing",
              "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "teaser", "toolbar", "topbar",
              "widget"}
#: Words of place and form beside which a word above still names boilerplate.
_FORM_WORDS = {"area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "footer",
               "form", "global", "group", "header", "icons", "inner", "item", "items", "left", "link", "links", "list", "main",
               "outer", "page", "panel", "post", "posts", "primary", "region", "right", "secondary", "section", "site", "slot",
               "thread", "top", "unit", "wrap", "wrapper"}
_PARTS = re.compile(r"[-_\d]+")
#: Words that name the lead of an article when they stand on a paragraph.
_LEAD_WORDS = {"teaser"}
#: What an opening tag ends when it is open: itself or its rivals, up to a border.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"})}


def _names_boilerplate(token: str) -> bool:
    """A class, id or role that is one of the words, or a compound of them
    with words of place and form only (`site-footer`, not `has-sidebar`)."""
    parts = [x for x in _PARTS.split(token) if x]
    return any(x in _OUT_WORDS for x in parts) and all(x in _OUT_WORDS or x in _FORM_WORDS for x in parts)


def _marks(attrs: str) -> tuple[set[str], set[str], bool]:
    """Tokens of class and role, and of id; whether the element is hidden."""
    named, ids, hidden = set(), set(), False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "role"):
            named.update(value.split())
        elif name == "id":
            ids.update(value.split())
        elif name == "hidden" or name == "aria-hidden":
            hidden |= value == "true" or name == "hidden"
    return named, ids, hidden


class Page:
    """The elements of a page in order of their opening tags, and its text
    nodes outside boilerplate elements."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.path: list[int] = []  # number of the root-to-here tag path
        self.named: list[bool] = []  # boilerplate by its class, id or role
        self.outer: list[int] = []  # the outermost article or main around, itself included; -1
        self.text_of: list[bool] = []  # inside a heading
        self.link: list[bool] = []
        self.out: list[bool] = []
        # text nodes: element (-1: none), block, group (blocks that only `br` parts), raw text
        self.nodes: list[tuple[int, int, int, str]] = []

    def sums(self, values: list[tuple[int, float]]) -> list[float]:
        """For every element the sum of the values in and below it."""
        total = [0.0] * len(self.tag)
        for e, v in values:
            if e >= 0:
                total[e] += v
        for e in range(len(total) - 1, 0, -1):
            if self.parent[e] >= 0:
                total[self.parent[e]] += total[e]
        return total


class _Stack:
    """Open elements; where the last one of a tag, or of a set of tags, lies."""

    def __init__(self, page: Page):
        self.page, self.open = page, []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, element: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in _BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(element)

    def cut(self, n: int) -> bool:
        """Close all from place ``n`` on; whether a block was among them."""
        block = False
        while len(self.open) > n:
            tag = self.page.tag[self.open.pop()]
            self.at[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()
                block = True
        return block


_HELD_P = frozenset(_SECTION | {"li", "table", "blockquote"})
_HELD_END = ("table", "td", "body", "html")


def parse(source: str) -> Page:
    page = Page()
    stack = _Stack(page)
    paths: dict[tuple[int, str], int] = {}
    block = group = at = pos = 0
    loose = False
    size = len(source)

    def text(lo: int, hi: int) -> None:
        if hi > lo:
            e = stack.open[-1] if stack.open else -1
            if e < 0 or not page.out[e]:
                raw = source[lo:hi]
                page.nodes.append((e, block, group, html.unescape(raw) if "&" in raw else raw))

    def close(n: int) -> None:
        nonlocal block, group
        if stack.cut(n):
            block += 1
            group += 1

    while True:
        lt = source.find("<", pos)
        if lt < 0:
            text(at, size)
            return page
        m = (_LOOSE if loose else _TOKEN).match(source, lt) or (_TOKEN.match(source, lt) if loose and source[lt + 1:lt + 2] in "!?" else None)
        if m is None and _OPEN_TAG.match(source, lt):
            if source.find(">", lt) < 0:  # the page ends inside a tag
                text(at, lt)
                return page
            loose = True
            m = _LOOSE.match(source, lt)
        if m is None:  # a plain character
            pos = lt + 1
            continue
        text(at, lt)
        pos = at = m.end()
        tag = (m[2] or "").lower()
        if not tag:  # comment, doctype
            continue
        if m[1]:
            if tag == "p" and not stack.at.get("p"):
                block += 1
                group += 1
            n = stack.last((tag,))
            held = stack.last([t for t in _HELD_END if t != tag])
            if tag not in _BLOCK and stack.blocks:
                held = max(held, stack.blocks[-1])
            if n > held:
                close(n)
            continue
        if tag in _BLOCK:
            n = stack.last(("p",)) if tag != "br" else -1  # a block ends an open paragraph
            if n > stack.last(_HELD_P):
                close(n)
            rivals, border = _ENDS.get(tag, ((), ()))
            n = stack.last(rivals)
            if n > stack.last(border):
                close(n)
            block += 1
            group += tag != "br"
        if tag in _VOID or m[3].rstrip().endswith("/"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(source, pos)
            pos = at = end.end() if end else size
            continue
        if tag == "body":  # what was left open before the body ends here
            stack.cut(int(bool(stack.open) and page.tag[stack.open[0]] == "html"))
        words, ids, hidden = _marks(m[3]) if m[3] else (set(), set(), False)
        up = stack.open[-1] if stack.open else -1
        outer = page.outer[up] if up >= 0 else -1
        if tag in _HEADING or tag in ("html", "body", "main") or (tag == "article" and not stack.at.get("article")):
            named = False
        elif tag == "p":
            named = any(map(_names_boilerplate, words - _LEAD_WORDS))
        else:
            named = any(map(_names_boilerplate, words | ids))
        out = hidden or tag in _OUT or (tag == "header" and outer < 0) or (up >= 0 and page.out[up])
        e = len(page.tag)
        label = tag + ("." + min(words | ids) if words or ids else "")
        page.parent.append(up)
        page.tag.append(tag)
        page.path.append(paths.setdefault((page.path[up] if up >= 0 else -1, label), len(paths)))
        page.named.append(named)
        page.outer.append(outer if outer >= 0 else e if tag in ("article", "main") else -1)
        page.text_of.append(tag in _HEADING or (up >= 0 and page.text_of[up]))
        page.link.append(tag == "a" or (up >= 0 and page.link[up]))
        page.out.append(out)
        stack.push(e, tag)


def _drop_named(page: Page) -> None:
    """Drop nodes in elements that are boilerplate by name. An element with
    most of the text is none, unless an article or main stands outside."""
    if not any(page.named):
        return
    size = [(n[0], len("".join(n[3].split()))) for n in page.nodes]
    under = [False] * len(page.tag)  # in an element that is boilerplate by name
    for e, p in enumerate(page.parent):
        under[e] = page.named[e] or (p >= 0 and under[p])
    strict = any(k and e >= 0 and not under[e] and page.outer[e] >= 0 for e, k in size)
    if not strict:
        total, inside = sum(k for _, k in size), page.sums(size)
        for e, p in enumerate(page.parent):
            under[e] = (page.named[e] and 2 * inside[e] <= total) or (p >= 0 and under[p])
    page.nodes = [n for n in page.nodes if n[0] < 0 or not under[n[0]]]


def content(page: Page, clean: list[str], live: list[int], threshold: float = THRESHOLD) -> list[int]:
    """The live nodes of the paths whose smoothed, fused ratios reach the
    threshold."""
    paths: dict[int, list[int]] = {}
    key = [page.path[page.nodes[i][0]] if page.nodes[i][0] >= 0 else -1 for i in live]
    for i, k in zip(live, key):
        s = paths.setdefault(k, [0, 0, 0])
        s[0] += 1
        s[1] += len(clean[i])
        s[2] += len(_PUNCT.findall(clean[i]))
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), SMOOTH, mode="valid")
    length = smooth(np.array([paths[k][1] / paths[k][0] for k in key]))
    points = smooth(np.array([paths[k][2] / paths[k][0] for k in key]))
    fused = length * (1 + points)
    number = {k: n for n, k in enumerate(paths)}
    at = np.array([number[k] for k in key])
    of_path = np.bincount(at, fused) / np.bincount(at)
    return [i for i, f in zip(live, of_path[at]) if f >= threshold * fused.mean()]


def _article(page: Page, chosen: list[int], size: list[int]) -> tuple[int, set[int]] | None:
    """The article or main that holds the content, and articles inside it that
    are others; None if most of the content stands outside of such elements."""
    mass = page.sums([(page.nodes[i][0], size[i]) for i in chosen])
    outers = {o for o in page.outer if o >= 0}
    if not outers or 2 * sum(mass[o] for o in outers) <= sum(size[i] for i in chosen):
        return None
    box = min(outers, key=lambda o: (-mass[o], o))
    inner, above = [], [-1] * len(page.tag)  # articles in the box that stand in no other one
    for e in range(box, len(page.tag)):
        p = page.parent[e]
        above[e] = e if page.tag[e] == "article" and e != box and (p < 0 or above[p] < 0) else above[p] if p >= 0 else -1
        if above[e] == e and page.outer[e] == box:
            inner.append(e)
    if len(inner) > 1:
        best = max(inner, key=lambda e: (mass[e], -e))
        if 2 * mass[best] > mass[box]:
            return box, set(inner) - {best}
    return box, set()


def main_text(source: str | None, threshold: float = THRESHOLD) -> str:
    page = parse(source or "")
    _drop_named(page)
    nodes = page.nodes
    clean = [" ".join(n[3].split()) for n in nodes]
    # groups whose text stands in links only do not choose the container
    linked: dict[int, bool] = {}
    for (e, _, group, _), t in zip(nodes, clean):
        if t:
            linked[group] = linked.get(group, True) and e >= 0 and page.link[e]
    live = [i for i, (n, t) in enumerate(zip(nodes, clean)) if t and not linked[n[2]]]
    live = live or [i for i, (n, t) in enumerate(zip(nodes, clean)) if t and n[0] >= 0 and page.outer[n[0]] >= 0]
    if not live:
        return ""
    chosen = content(page, clean, live, threshold)
    size = [len(t) for t in clean]
    found = _article(page, chosen, size)
    if found:
        box, others = found
    else:
        # a heading belongs to content that begins close behind it
        hit = set(chosen)
        needed = [i for k, i in enumerate(live) if i in hit or (
            nodes[i][0] >= 0 and page.text_of[nodes[i][0]] and any(j in hit for j in live[k + 1:k + 4]))]
        held = page.sums([(nodes[i][0], 1) for i in needed])
        box = max((e for e in range(len(page.tag)) if held[e] == len(needed) and page.tag[e] in _SECTION), default=-1)
        others = set()
    inside = [False] * len(page.tag)
    for e, p in enumerate(page.parent):
        inside[e] = e == box or (p >= 0 and inside[p] and e not in others)
    whole = box < 0 or page.tag[box] in ("body", "html")
    blocks: dict[int, list[str]] = {}
    first, last = (nodes[needed[0]][1], nodes[needed[-1]][1]) if whole else (0, 0)
    for e, block, _, raw in nodes:
        if (box < 0 or (e >= 0 and inside[e])) and (not whole or first <= block <= last):
            blocks.setdefault(block, []).append(raw)
    texts = (" ".join("".join(b).split()) for _, b in sorted(blocks.items()))
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every row of ``pages``. Map only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])
    return pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(
        run, "id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", "n_chars")
