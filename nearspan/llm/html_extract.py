"""Main text of web pages: boosted trees over DOM nodes, decoded from the root down.

A page is read into a tree of block elements and text runs. Each node is described by
itself (tag, attribute tokens, depth), its subtree (text, link density, tags) and its
siblings; boosted trees give the log-odds that it belongs to the article. Decoding takes
the labelling of highest total log-odds in which no kept node has a dropped ancestor, so
decisions never contradict each other. The trees learn from pages written by
``example_page``, a fixed pseudo-random grammar of page layouts with known articles; pages whose
markup names none of its boxes have trees of their own, learned from ``bare_page``.

Defined cases: a null or empty page, or one without text to keep, gives the empty string;
broken markup is closed where the next block begins or the page ends; what stands in
scripts, styles, form controls, templates, titles, frames and comments is never text; a
header or footer element is no part of the article, an article's own included; ids and urls
may be null or repeated, each page is read on its own; an empty table gives an empty result;
other columns, whatever their names, are never looked at; a very long page is read whole, in
time proportional to its length. White space inside a block is one space, blocks are joined
by a line break.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearspan.llm.common import Booster, map_rows

# How elements behave.
RAW = ("script", "style", "iframe", "textarea", "title")
DROPPED = ("button", "select", "template")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: What holds text but makes no block: fallbacks, formulas, drawings.
TRANSPARENT = ("noscript", "object", "param", "canvas", "svg", "g", "path", "circle", "ellipse", "rect", "line", "polyline", "polygon", "text", "tspan", "defs", "use", "symbol", "desc", "math", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mtable", "mtr", "mtd", "mstyle", "mpadded", "semantics", "annotation")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "img", "wbr", *TRANSPARENT)
CLOSES_P = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
KINDS = ("#text", "p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "li", "h1", "h2", "h3", "table", "tr", "td", "figure", "blockquote", "body", "html", "head")
BAD = ("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "cookie", "discussion", "disqus", "footer", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "replies", "respond", "share", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget")
GOOD = ("article", "body", "content", "entry", "main", "post", "story", "text")
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")

# A quote delimits a value only right after "="; else a tag ends at the first ">".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+>|[^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_RIGHTS = re.compile(r"\u00a9|\bcopyright\b|\(c\)|\brights reserved\b", re.I)
_OPENING = re.compile(r"<[A-Za-z/!?]")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_SAME = {t: re.compile(rf"<(/?){t}(?![A-Za-z0-9:-])", re.I) for t in DROPPED}


class Node:
    __slots__ = ("tag", "parent", "children", "bad", "good", "role", "text", "links")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.bad = self.good = self.role = 0
        self.text, self.links = [], 0
        if "=" in attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values)
                parts = {x.lower() for x in _PART.findall(value)}
                self.bad += len(parts.intersection(BAD))
                self.good += len(parts.intersection(GOOD))
                self.role += name.lower() == "role" and value.lower() in ROLES
        if parent is not None:
            parent.children.append(self)


def parse(page: str) -> Node:
    """The tree of block elements; runs of inline content are #text nodes."""
    # A tag that the page ends in the middle of is dropped, with what follows it.
    cut = _OPENING.search(page, page.rfind(">") + 1)
    page = page[: cut.start()] if cut else page
    root = node = Node("#root", None)
    #: Open elements by tag, so that a stray end tag need not be looked for up the tree.
    opened: Counter = Counter()
    run: Node | None = None
    in_link, at = 0, 0
    # The dropped element that is open, how often, whether it is closed by a tag, and the blocks in it.
    muted, times, ends, inner, held = "", 0, False, [], Counter()
    while at < len(page):
        m = _TOKEN.search(page, at)
        data = page[at : m.start() if m else len(page)]
        if data and not muted:
            if run is None:
                run = Node("#text", node)
            run.text.append(data)
            if in_link:
                run.links += len(data)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3][:-1]
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br" and run is not None:
                run.text.append(" ")
            continue
        if tag in DROPPED:
            if closing:
                times -= muted == tag
            elif not attributes.endswith("/") and (not muted or muted == tag):
                again = _SAME[tag].search(page, at)
                nested = muted == tag == "template"
                muted, times, inner, held = tag, times + 1 if nested else 1, inner if nested else [], held if nested else Counter()
                ends = again is not None and (bool(again[1]) or tag == "template")
            if not times:
                muted = ""
            continue
        if muted and (ends or tag in ("option", "optgroup")):
            if closing and held[tag]:
                last = None
                while last != tag:
                    last = inner.pop()
                    held[last] -= 1
                continue
            if not closing or not opened[tag]:
                if not closing and tag not in VOID:
                    inner.append(tag)
                    held[tag] += 1
                continue
        muted, times = "", 0
        run = None
        if closing:
            if opened[tag]:
                while node.tag != tag:
                    opened[node.tag] -= 1
                    node = node.parent
                opened[tag] -= 1
                node = node.parent
                in_link = 0
            continue
        if tag in VOID:
            continue
        # What an opening tag closes by itself.
        if tag in CLOSES_P and node.tag == "p" or tag == node.tag and tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            opened[node.tag] -= 1
            node = node.parent
        if tag == "body" and node.tag == "head":
            opened["head"] -= 1
            node = node.parent
        inside = Node(tag, node, attributes)
        if not attributes.endswith("/"):
            node = inside
            opened[tag] += 1
    return root


def describe(root: Node) -> tuple[list[Node], list[int], np.ndarray, list[str]]:
    """The nodes in page order, their parents' places, their features, the texts of runs."""
    nodes: list[Node] = []
    stack, parents, depth = [(root, -1, 0)], [], []
    while stack:
        node, up, d = stack.pop()
        here = len(nodes)
        nodes.append(node)
        parents.append(up)
        depth.append(d)
        stack += [(c, here, d + 1) for c in reversed(node.children)]
    n = len(nodes)
    texts = [_SPACE.sub(" ", html.unescape("".join(x.text))).strip() if x.tag == "#text" else "" for x in nodes]
    size, links, tags, stops, paragraphs = [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#text":
            size[i] += len(texts[i])
            links[i] += min(x.links, len(texts[i]))
            stops[i] += texts[i].count(".") + texts[i].count(",")
        paragraphs[i] += x.tag == "p"
        if parents[i] >= 0:
            up = parents[i]
            for v in (size, links, tags, stops, paragraphs):
                v[up] += v[i]
    total = max(1, size[0])
    place = [0] * n
    bad_above, article_above = [0] * n, [0] * n
    for i in range(1, n):
        up = parents[i]
        bad_above[i] = bad_above[up] or int(nodes[up].bad > 0 or nodes[up].role > 0 or nodes[up].tag in ("nav", "header", "footer", "aside", "form"))
        article_above[i] = article_above[up] or int(nodes[up].tag in ("article", "main"))
    # Words of ownership in a short stretch, and how much text stands before.
    marks, before, seen = [0] * n, [0] * n, 0
    for i in range(n):
        before[i] = seen
        seen += len(texts[i])
        marks[i] = int(bool(texts[i]) and len(texts[i]) < 400 and bool(_RIGHTS.search(texts[i])))
    for i in range(n - 1, 0, -1):
        if marks[i] and size[parents[i]] < 400:
            marks[parents[i]] = 1
    order: dict[int, int] = {}
    for i in range(1, n):
        place[i] = order.get(parents[i], 0)
        order[parents[i]] = place[i] + 1
    kind = {t: k for k, t in enumerate(KINDS)}
    rows = []
    for i, x in enumerate(nodes):
        up = nodes[parents[i]] if i else x
        rows.append(
            (
                kind.get(x.tag, len(KINDS)),
                kind.get(up.tag, len(KINDS)),
                x.bad,
                x.good,
                x.role,
                up.bad,
                up.good,
                bad_above[i],
                article_above[i],
                depth[i],
                math.log1p(size[i]),
                size[i] / total,
                links[i] / max(1, size[i]),
                size[i] / tags[i],
                stops[i] / max(1, size[i]),
                math.log1p(paragraphs[i]),
                len(up.children),
                place[i] / max(1, len(up.children)),
                x.tag in ("nav", "header", "footer", "aside", "form", "head"),
                x.tag in ("article", "main"),
                # From here on for pages without names.
                marks[i],
                before[i] / total,
                links[parents[i]] / max(1, size[parents[i]]) if i else 0.0,
                math.log1p(size[parents[i]]) if i else 0.0,
            )
        )
    return nodes, parents, np.array(rows, float), texts


def decode(parents: list[int], odds: np.ndarray) -> list[bool]:
    """The labelling of highest total log-odds in which every kept node's parent is kept (ties drop)."""
    n = len(parents)
    gain = odds.tolist()
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[parents[i]] += gain[i]
    kept = [gain[0] > 0] * n
    for i in range(1, n):
        kept[i] = kept[parents[i]] and gain[i] > 0
    return kept


def example_page(r: random.Random) -> tuple[str, set[str]]:
    """A page of some layout, and the texts of its article's runs."""
    syllables = ("er", "an", "th", "ti", "lo", "ma", "den", "es", "ou", "que", "ch", "ing")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + "."
    kept: set[str] = set()

    def keep(text: str) -> str:
        kept.add(text)
        return text

    def box(names: tuple, inside: str, tags: tuple = ("div", "section", "aside")) -> str:
        name, tag = r.choice(names), r.choice(tags)
        extra = r.choice(("", "-box", "-wrap", " block", "_1"))
        return f'<{tag} {r.choice(("class", "id"))}="{name}{extra}">{inside}</{tag}>'

    links = lambda k: "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k)) + "</ul>"
    blurb = lambda: r.choice((prose(2, 14), f"<p>{prose(2, 20)}</p>", f"<h3>{prose(1, 3)}</h3><p>{prose(4, 20)}</p>", links(r.randint(2, 6))))

    def paragraph() -> str:
        x = r.randrange(14)
        if x == 0:
            return f"<h2>{keep(prose(1, 6))}</h2>"
        if x == 1:
            return "<ul>" + "".join(f"<li>{keep(prose(3, 12))}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
        if x == 2:
            return f"<blockquote><p>{keep(prose(5, 30))}</p></blockquote>"
        if x == 3:
            return f"<p>{keep(prose(1, 2))}</p>"
        if x == 4:
            return f"<table><tr><td>{keep(prose(1, 4))}</td><td>{keep(prose(1, 4))}</td></tr></table>"
        return f"<p>{keep(prose(3, 90))}" + r.choice(("</p>", "</p>", "</p>", ""))

    inner = "".join(paragraph() for _ in range(r.choice((1, 2, 4, 8, 14))))
    if r.random() < 0.3:
        at = inner.rfind("<p>")
        inner = inner[: max(at, 0)] + box(("ad", "advert", "related", "share", "promo", "newsletter", "social"), blurb()) + inner[max(at, 0) :]
    head = f"<h1>{keep(prose(2, 9))}</h1>" if r.random() < 0.8 else ""
    if r.random() < 0.15:
        inner += box(("comments", "comment-list", "disqus", "replies"), "".join(f"<div class=\"comment\"><p>{prose(3, 40)}</p></div>" for _ in range(r.randint(1, 5))), ("div", "section"))
    article = r.choice(
        (
            lambda b: f"<article>{b}</article>",
            lambda b: f"<article>{b}</article>",
            lambda b: f"<main><article class=\"post\">{b}</article></main>",
            lambda b: f"<main>{b}</main>",
            lambda b: f'<div class="{r.choice(("content", "entry", "post", "story", "article-body", "main-text"))}">{b}</div>',
            lambda b: f'<div id="page"><div class="{r.choice(("content", "post-content", "c1"))}">{b}</div></div>',
        )
    )(head + inner)
    before = [f"<nav>{links(r.randint(2, 9))}</nav>"] if r.random() < 0.7 else []
    if r.random() < 0.4:
        before.append(r.choice((f"<header><h1>{prose(1, 3)}</h1></header>", box(("header", "masthead", "banner", "navbar", "menu"), links(4), ("div",)))))
    if r.random() < 0.7:
        before.append(box(("ad", "ads", "banner", "advert", "cookie-notice", "promo", "sponsored"), blurb()))
    after = []
    if r.random() < 0.3:
        after.append(r.choice((f"<aside>{blurb()}{blurb()}</aside>", box(("sidebar", "widget", "related"), blurb() + blurb()))))
    if r.random() < 0.2:
        after.append(f"<form action=\"/s\"><label>{prose(1, 3)}</label><input name=q><p>{prose(1, 6)}</p></form>")
    if r.random() < 0.25:
        after.append(box(("comments", "discussion", "respond"), "".join(f"<p>{prose(3, 40)}</p>" for _ in range(r.randint(1, 5))), ("div", "section")))
    if r.random() < 0.8:
        after.append(r.choice((f"<footer>&copy; {word()} &middot; {prose(2, 16)}</footer>", box(("footer", "site-footer"), prose(2, 16), ("div",)))))
    page = f"<!DOCTYPE html><html><head><title>{prose(1, 9)}</title></head><body>{''.join(before)}{article}{''.join(after)}"
    return page + r.choice(("", "</body></html>")), kept


def bare_page(r: random.Random) -> tuple[str, set[str]]:
    """A page whose boxes have no names: menus are links, notices and rights are words, the rest is the article."""
    syllables = ("er", "an", "th", "ti", "lo", "ma", "den", "es", "ou", "que", "ch", "ing")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda a, b: " ".join(word() + ("," if r.random() < 0.08 else "") for _ in range(r.randint(a, b))).strip(",").capitalize()
    kept: set[str] = set()

    def keep(text: str) -> str:
        kept.add(text)
        return text

    kind = r.choice(("div", "table", "flat"))
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, 2))).capitalize()}</a>'
    listed = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
    rowed = lambda k: r.choice((" | ", " ", " &middot; ", " - ")).join(link() for _ in range(k))

    def box(inside: str) -> str:
        if kind == "table":
            return f"<table><tr><td>{inside}</td></tr></table>"
        if kind == "div" or not inside.startswith("<"):
            return f"<div>{inside}</div>"
        return inside

    def block() -> str:
        x = r.randrange(12)
        if x == 0:
            return f"<h2>{keep(prose(1, 6))}</h2>"
        if x == 1:
            return "<ul>" + "".join(f"<li>{keep(prose(3, 12))}.</li>".replace(".</li>", "</li>") for _ in range(r.randint(2, 4))) + "</ul>"
        if x == 2:
            return f"<blockquote><p>{keep(prose(5, 30) + '.')}</p></blockquote>"
        if x == 3:
            return f"<p>{keep(prose(2, 5) + '.')}</p>"
        return f"<p>{keep(prose(6, 90) + '.')}</p>"

    inner = (f"<h1>{keep(prose(2, 9))}</h1>" if r.random() < 0.7 else "") + "".join(block() for _ in range(r.choice((1, 2, 2, 3, 5, 9))))
    rights = r.choice(("Copyright {} {}", "&copy; {} {}", "{1} &copy; {0}", "Copyright (c) {} by {}. All rights reserved.")).format(r.randint(1995, 2026), word().capitalize())
    menu = lambda: box(r.choice((listed, rowed))(r.randint(2, 9)))
    before = [menu() for _ in range(r.choice((0, 1, 1, 1, 2)))]
    after = [menu() for _ in range(r.choice((0, 0, 0, 1)))]
    if r.random() < 0.8:
        after.append(box(r.choice((rights, rights, f"<p>{rights}</p>", rowed(r.randint(2, 5)) + " " + rights))))
    body = "".join([*before, box(inner) if r.random() < 0.8 else inner, *after])
    if r.random() < 0.4:
        return body, kept
    return f"<html><head><title>{prose(1, 9)}</title></head><body>{body}</body></html>", kept


#: Features of a node that the trees for named pages look at.
NAMED_FEATURES = 20


def _fitted(write, pages: int, seed: int, width: int | None) -> Booster:
    r, x, y = random.Random(seed), [], []
    for _ in range(pages):
        page, kept = write(r)
        nodes, parents, rows, texts = describe(parse(page))
        good = [t in kept and bool(t) for t in texts]
        for i in range(len(nodes) - 1, 0, -1):
            good[parents[i]] = good[parents[i]] or good[i]
        for i in range(len(nodes)):
            if nodes[i].tag != "#text" or texts[i]:
                x.append(rows[i][:width])
                y.append(float(good[i]))
    return Booster(rounds=80, depth=4, rate=0.25).fit(np.array(x), np.array(y))


@lru_cache(1)
def model() -> tuple[Booster, Booster]:
    """Trees for pages that name any of their boxes, and for those that name none."""
    return _fitted(example_page, 700, 3, NAMED_FEATURES), _fitted(bare_page, 500, 4, None)


def names_boxes(nodes: list[Node]) -> bool:
    return any(n.bad or n.good or n.role or n.tag in ("nav", "header", "footer", "aside", "article", "main") for n in nodes)


def main_texts(pages: list[str | None], trees: tuple[Booster, Booster]) -> list[str]:
    """The main text of each page; the nodes of all pages are scored together."""
    parsed = [describe(parse(p)) if p else None for p in pages]
    rows = [d[2] for d in parsed if d]
    if not rows:
        return [""] * len(pages)
    every = np.concatenate(rows)
    named = np.concatenate([np.full(len(d[2]), names_boxes(d[0])) for d in parsed if d])
    odds, at, out = np.empty(len(every)), 0, []
    odds[named], odds[~named] = trees[0].score(every[named][:, :NAMED_FEATURES]), trees[1].score(every[~named])
    for d in parsed:
        if d is None:
            out.append("")
            continue
        nodes, parents, x, texts = d
        own = odds[at : at + len(x)]
        at += len(x)
        # A run without text has no say.
        own = np.where([n.tag == "#text" and not t for n, t in zip(nodes, texts, strict=True)], 0.0, own)
        kept = decode(parents, own)
        out.append("\n".join(t for t, k in zip(texts, kept, strict=True) if k and t))
    return out


_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_html(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(rows: dict) -> dict:
        texts = main_texts(rows[markup], shared.value)
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages, ["page_id", "url", markup], _SCHEMA, run)
