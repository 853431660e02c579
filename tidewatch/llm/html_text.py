"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags). Each block has features of its ancestors' tags and of
names in their class, id and role attributes, told apart by whether the ancestor lies in the article's element or beside it;
of where it stands to the main heading; and of its text. An ancestor that holds the article itself says nothing by its name. The
field is trained on labelled pages: some written out and many composed of labelled parts, in many layouts. Viterbi decoding
marks the blocks of the article. All steps take time in proportion to the page.
"""

from __future__ import annotations

import functools
import html
import itertools
import random
import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Composed pages to learn from, and rounds of learning.
LEARN_PAGES, ROUNDS = 260, 120

# HTML element kinds.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe canvas title textarea select button video audio".split())
RAW = frozenset("script style textarea title iframe noscript".split())
# Parts of class, id and role names, by what they tell.
NAMES = {
    "nav": ("nav", "menu", "breadcrumb", "breadcrumbs", "toc", "pager", "pagination", "tabs", "navigation"),
    "ad": ("ad", "ads", "adv", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored"),
    "comment": ("comment", "comments", "reply", "replies", "disqus", "respond", "discussion"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommended", "share", "social", "more"),
    "foot": ("footer", "foot", "copyright", "legal", "contentinfo", "credits"),
    "head": ("header", "masthead", "topbar", "logo", "brand"),
    "notice": ("notice", "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe", "popup", "modal", "alert", "signup", "login"),
    "body": ("content", "article", "post", "entry", "story", "main", "text"),
}
_NAMED = {part: kind for kind, parts in NAMES.items() for part in parts}
_BESIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset")  # tags of parts that aren't the article
_WITHIN = ("ul", "ol", "table", "figure", "dl", "details", "section", "blockquote")
_TAGS = ("p", "li", "div", "td", "pre", "blockquote", "figcaption", "h1", "h2", "h3", "h4", "body", "article", "section", "dd", "main")
_MARKS = [*_BESIDE, *(f"name:{n}" for n in NAMES if n != "body")]
FEATURES = {
    f: k
    for k, f in enumerate([
        "bias", *(f"{m}/{where}" for m in _MARKS for where in ("in", "out")), *(f"in:{t}" for t in _WITHIN), *(f"tag:{t}" for t in _TAGS), "tag:other", "root", "card", "beside", "rootless",
        "heading", "before", "after", "headless", *(f"len:{k}" for k in range(12)), "links:some", "links:most", "ends", "mark", "digits",
    ])
}
_NAME_OF = {f"name:{n}/{where}": n for n in NAMES for where in ("in", "out")}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[a-zA-Z/!?](?:\"[^\"]*\"|'[^']*'|[^'\"<>]+)*+>|<[a-zA-Z/!?][^<>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGIT = re.compile(r"\d")
_CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option"}
#: Stands before the text of a block of the article in a labelled page.
MARK = "\ue000"


@dataclass(slots=True)
class Block:
    text: str
    features: list[int]
    names: frozenset


@dataclass(slots=True)
class Tag:
    start: int
    end: int
    name: str
    kind: str  # "open", "close", or "empty" for one that holds nothing
    text: str


@dataclass(slots=True)
class Element:
    tag: str
    names: frozenset
    root: int | None  # the nearest element around it that may be the article's
    first: int  # its blocks
    last: int = 0


@functools.lru_cache(maxsize=4096)
def _kind_of(part: str) -> str | None:
    """The kind of a part of a name; one that isn't known goes by the known one of four letters or more that it ends with."""
    return _NAMED.get(part) or next((_NAMED[part[k:]] for k in range(1, len(part) - 3) if part[k:] in _NAMED), None)


def _kinds(tag: str) -> frozenset:
    names = (m[1] or m[2] or m[3] or "" for m in _ATTRIBUTE.finditer(tag))
    parts = (p.lower() for n in names for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", n))
    return frozenset(k for p in parts if (k := _kind_of(p[:40])))


@functools.cache
def _end_tag(t: str) -> re.Pattern:
    return re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I)


class Opened:
    """Open elements, each with a number; the innermost of a name is found at once."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.at: dict[str, list[int]] = defaultdict(list)

    def push(self, name: str, number: int) -> None:
        self.at[name].append(len(self.stack))
        self.stack.append((name, number))

    def pop(self) -> int:
        name, number = self.stack.pop()
        self.at[name].pop()
        return number

    def close(self, name: str) -> list[int]:
        """Takes the innermost element of the name, and all in it, off; their numbers from the inside out."""
        if not self.at[name]:
            return []
        k = self.at[name][-1]
        return [self.pop() for _ in range(len(self.stack) - k)]


def _tags(page: str) -> list[Tag]:
    """All tags outside raw elements; a raw element, in which nothing is markup, is one empty tag (without an end tag it goes to the page's end)."""
    out, at = [], 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        tag = m[0]
        name = _NAME.match(tag)
        if not name or tag.startswith("<!"):
            out.append(Tag(m.start(), at, "", "empty", ""))
            continue
        t = name[1].lower()
        kind = "close" if tag[1] == "/" else "empty" if t in VOID or tag.endswith("/>") else "open"
        if kind == "open" and t in RAW:
            end = _end_tag(t).search(page, at)
            at, kind = end.end() if end else len(page), "empty"
        out.append(Tag(m.start(), at, t, kind, tag))
    return out


def _hidden(tags: list[Tag], size: int) -> dict[int, int]:
    """Where each hidden element (by the number of its tag) ends.

    Up to its end tag. One that isn't closed before its parent's end tag, or the page's end, goes up to the first block-level
    tag in it, or to there. Buttons and selects don't nest: one ends where the next of its kind begins.
    """
    block, after = size, [size] * (len(tags) + 1)  # where the first block-level tag from each tag on starts
    for k in range(len(tags) - 1, -1, -1):
        if tags[k].name in BLOCK and tags[k].kind != "close":
            block = tags[k].start
        after[k] = block
    opened, ends = Opened(), {}
    for k, t in enumerate(tags):
        if t.kind == "empty":
            continue
        again = t.kind == "open" and t.name in ("button", "select")
        if t.kind == "close" or again:
            closed = opened.close(t.name)
            for n in closed:
                if tags[n].name in HIDDEN:
                    whole = n == closed[-1] and not again
                    ends[n] = t.end if whole else min(after[n + 1], t.start)
        if t.kind == "open":
            opened.push(t.name, k)
    for name, n in opened.stack:
        if name in HIDDEN:
            ends[n] = after[n + 1]
    return ends


def _parse(page: str) -> tuple[list[tuple[str, str, float]], list[Element]]:
    """Blocks (text, nearest tag, share of its characters in links) and elements that may tell something."""
    tags = _tags(page)
    hidden = _hidden(tags, len(page))
    starts = [t.start for t in tags]
    out: list[tuple[str, str, float]] = []
    elements: list[Element] = []
    opened, roots = Opened(), []
    piece: list[str] = []
    linked, in_link = 0, False

    def flush():
        nonlocal linked
        if not piece:
            return
        raw = "".join(piece)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            out.append((text, opened.stack[-1][0] if opened.stack else "body", linked / len(raw)))
        piece.clear()
        linked = 0

    def words(s: str):
        nonlocal linked
        if s:
            piece.append(s)
            linked += len(s) if in_link else 0

    def shut(numbers: list[int]):
        for n in numbers:
            if n >= 0:
                elements[n].last = len(out)
                if roots and roots[-1] == n:
                    roots.pop()

    at, k = 0, 0
    while k < len(tags):
        t = tags[k]
        words(page[at : t.start])
        at, k = t.end, k + 1
        if not t.name:
            continue
        if t.kind == "close":
            if t.name == "a":
                in_link = False
            elif t.name in BLOCK:
                flush()
                shut(opened.close(t.name))
            continue
        if t.name in HIDDEN:
            if t.kind == "open":
                at = hidden[k - 1]
                k = bisect_left(starts, at, k)
            continue
        if t.name == "br":
            words(" ")
        elif t.name == "a":
            in_link = t.kind == "open"
        elif t.name in BLOCK:
            flush()
            in_link = False
            top = opened.stack[-1][0] if opened.stack else ""
            if top == "p" or top and (_CLOSES.get(t.name) == top or top == t.name and top in _CLOSES):
                shut([opened.pop()])
            if t.kind == "open":
                names = frozenset() if t.name in ("html", "body") else _kinds(t.text)
                root = t.name in ("article", "main") or "body" in names
                number = -1
                if names or root or t.name in _BESIDE or t.name in _WITHIN:
                    number = len(elements)
                    elements.append(Element(t.name, names, roots[-1] if roots else None, len(out)))
                if root:
                    roots.append(number)
                opened.push(t.name, number)
    words(page[at:])
    flush()
    shut([n for _, n in reversed(opened.stack)])
    return out, elements


def _heading(found: list[tuple[str, str, float]], elements: list[Element]) -> int | None:
    """The block of the main heading: the first h1 of what may be the article, else one that isn't in a part beside it, else an h2 there."""
    n = len(found)
    inside, beside = np.zeros(n + 1, int), np.zeros(n + 1, int)
    for e in elements:
        if e.tag in ("article", "main") or "body" in e.names:
            inside[e.first] += 1
            inside[e.last] -= 1
        if e.tag in ("nav", "header", "footer", "aside"):
            beside[e.first] += 1
            beside[e.last] -= 1
    inside, beside = inside.cumsum().tolist(), beside.cumsum().tolist()
    tags = [t for _, t, _ in found]
    for fits in (lambda k: tags[k] == "h1" and inside[k], lambda k: tags[k] == "h1" and not beside[k], lambda k: tags[k] == "h2" and inside[k], lambda k: tags[k] == "h1"):
        if (k := next((k for k in range(n) if fits(k)), None)) is not None:
            return k
    return None


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. Open tags that are never closed, and a cut-off end, are borne.

    A head shows nothing by itself (its elements are hidden or empty), so it needn't be closed.
    """
    found, elements = _parse(page)
    if not found:
        return []
    n = len(found)
    upto = [0, *itertools.accumulate(len(t) for t, _, _ in found)]
    main = _heading(found, elements)
    holds = lambda e: main is not None and e.first <= main < e.last
    share = lambda e: (upto[e.last] - upto[e.first]) / upto[-1]
    roots = [k for k, e in enumerate(elements) if e.tag in ("article", "main") or "body" in e.names]
    first_root = min((elements[k].first for k in roots), default=None)
    is_root = {k: holds(elements[k]) or share(elements[k]) >= 0.5 for k in roots}
    in_root: dict[int, bool] = {}
    edges: dict[str, np.ndarray] = {}

    def over(name: str, e: Element):
        if name not in edges:
            edges[name] = np.zeros(n + 1, np.int32)
        edges[name][e.first] += 1
        edges[name][e.last] -= 1

    for k, e in enumerate(elements):
        in_root[k] = e.root is not None and (is_root[e.root] or in_root[e.root])
        if e.first == e.last:
            continue
        if k in is_root:
            over("root" if is_root[k] else "card", e)
        if e.tag in _WITHIN:
            over(f"in:{e.tag}", e)
        # what holds the article itself says nothing by its name
        if main is not None:
            wide = holds(e) and share(e) >= 0.3
        else:
            wide = share(e) >= 0.6 and (first_root is None or e.first <= first_root < e.last)
        if not wide:
            where = "in" if in_root[k] else "out"
            for m in ([e.tag] if e.tag in _BESIDE else []) + [f"name:{x}" for x in e.names if x != "body"]:
                over(f"{m}/{where}", e)
    names = list(edges)
    there = np.stack([edge.cumsum()[:n] > 0 for edge in edges.values()], axis=1) if names else np.zeros((n, 0), bool)
    at, which = np.nonzero(there)
    at, which, any_root = np.searchsorted(at, np.arange(n + 1)).tolist(), which.tolist(), any(is_root.values())
    out = []
    for k, (text, tag, links) in enumerate(found):
        has = [names[x] for x in which[at[k] : at[k + 1]]]
        features = ["bias", *has, f"tag:{tag if tag in _TAGS else 'other'}", f"len:{min(11, len(text).bit_length())}"]
        if "root" not in has:
            features.append("beside" if any_root else "rootless")
        features.append("headless" if main is None else "heading" if k == main else "before" if k < main else "after")
        features += ["links:most"] * (links > 0.6) + ["links:some"] * (0.2 < links <= 0.6) + ["ends"] * (text[-1] in ".!?…\"”") + ["mark"] * ("©" in text) + ["digits"] * (len(_DIGIT.findall(text)) * 5 > len(text))
        out.append(Block(text, [FEATURES[f] for f in features], frozenset(_NAME_OF[f] for f in has if f in _NAME_OF)))
    return out


# Labelled pages. Parts are written out; composed pages put them together, in many layouts.
_WORDS = "the a of and in on with for from by river market teacher old winter city garden report number small early later group water paper found walked began called built after before while people some every through between across new house".split()


class _Composer:
    """Composes labelled pages: what is of the article starts with MARK."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def some(self, low: int, high: int, stop: str = ".") -> str:
        words = [self.r.choice(_WORDS) for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + stop

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href=/x>{self.some(1, 4, '')}</a></{tag}>" for _ in range(n))

    def named(self, *names: str) -> str:
        return f"{self.r.choice(('class', 'class', 'id'))}='{self.r.choice(names)}'"

    def paragraph(self) -> str:
        short = self.r.random() < 0.25
        return f"<p>{MARK}{self.some(2, 7) if short else self.some(12, 70)}{self.r.choice(('</p>', '</p>', ''))}"

    def part(self) -> str:
        """A part of the article that isn't a plain paragraph."""
        r, m = self.r, MARK
        return r.choice((
            lambda: f"<ul>{''.join(f'<li>{m}{self.some(2, 12, r.choice((".", "")))}</li>' for _ in range(r.randint(2, 5)))}</ul>",
            lambda: f"<ol>{''.join(f'<li><p>{m}{self.some(4, 20)}</p></li>' for _ in range(r.randint(2, 4)))}</ol>",
            lambda: f"<table>{''.join(f'<tr><td>{m}{self.some(1, 3, "")}</td><td>{m}{r.randint(1, 900)}</td></tr>' for _ in range(r.randint(2, 4)))}</table>",
            lambda: f"<blockquote>{m}{self.some(8, 30)}</blockquote>",
            lambda: f"<blockquote><p>{m}{self.some(8, 30)}</p></blockquote>",
            lambda: f"<figure><img src=x><figcaption>{m}{self.some(4, 12)}</figcaption></figure>",
            lambda: f"<pre>{m}x = {r.randint(1, 99)}</pre>",
            lambda: f"<dl><dt>{m}{self.some(1, 2, '')}<dd>{m}{self.some(5, 14)}</dl>",
            lambda: f"<h{(k := r.randint(2, 4))}>{m}{self.some(2, 6, '')}</h{k}>",
            lambda: f"<section><h2>{m}{self.some(2, 5, '')}</h2><p>{m}{self.some(14, 40)}</p></section>",
            lambda: f"<div>{m}{self.some(10, 40)}</div>",
            lambda: f"<p>{m}<a href=/y>{self.some(2, 5, '')}</a> {self.some(6, 20)}</p>",
        ))()

    def noise(self) -> str:
        """A part that stands in or beside an article and isn't of it."""
        r, say = self.r, self.some
        return r.choice((
            lambda: f"<aside><p>{say(3, 25)}</p></aside>",
            lambda: f"<aside {self.named('related', 'sidebar')}><h3>{say(1, 3, '')}</h3><ul>{self.links(3)}</ul></aside>",
            lambda: f"<div {self.named('share', 'social', 'share-bar')}><p><a href=/s>{say(1, 2, '')}</a></p></div>",
            lambda: f"<div {self.named('ad', 'advert', 'promo', 'ad-slot', 'sponsored')}><p>{say(3, 20)}</p></div>",
            lambda: f"<div {self.named('ad', 'banner')}>{say(3, 12)}</div>",
            lambda: f"<form><p>{say(2, 8, '')}</p><input name=q></form>",
            lambda: f"<form {self.named('newsletter', 'signup', 'f1')}><label>{say(2, 5, '')}</label><p>{say(3, 16)}</p></form>",
            lambda: f"<div {self.named('newsletter', 'subscribe', 'cookie-notice', 'alert')}><p>{say(5, 25)}</p></div>",
            lambda: f"<nav {self.named('toc', 'pager', 'x')}><ul>{self.links(3)}</ul></nav>",
            lambda: f"<div {self.named('related', 'more', 'widget')}><ul>{self.links(3)}</ul></div>",
            lambda: f"<div {self.named('related-posts', 'recommended')}>{''.join(f'<article><h3>{say(2, 6, "")}</h3><p>{say(6, 14)}</p></article>' for _ in range(2))}</div>",
        ))()

    def comments(self) -> str:
        r, n = self.r, self.r.randint(1, 6)
        each = r.choice((f"<p>{{}}</p>", "<div class=comment><p>{}</p></div>", "<li>{}</li>"))
        texts = "".join(each.format(self.some(3, 60)) for _ in range(n))
        return r.choice((f"<section class=comments><h2>{n} comments</h2>{texts}</section>", f"<div id=comments>{texts}<form><p>Your name</p></form></div>", f"<div class='discussion replies'>{texts}</div>"))

    def article(self) -> str:
        r = self.r
        title = r.choice((f"<h1>{MARK}{self.some(3, 8, '')}</h1>", f"<header><h1>{MARK}{self.some(3, 8, '')}</h1></header>", f"<h1>{MARK}{self.some(3, 8)}</h1>", f"<h1>{MARK}{self.some(3, 8, '')}</h1>", f"<h2>{MARK}{self.some(3, 8, '')}</h2>", ""))
        parts = [self.part() if r.random() < 0.3 else self.paragraph() for _ in range(r.randint(1, 9))]
        for _ in range(r.choice((0, 0, 1, 2))):
            parts.insert(r.randint(1, len(parts)), self.noise())
        return title + "".join(parts) + (f"<footer><p>{self.some(2, 9, '')}</p></footer>" if r.random() < 0.15 else "") + (self.comments() if r.random() < 0.15 else "")

    def page(self) -> str:
        r, say = self.r, self.some
        top = [r.choice((
            lambda: f"<nav><ul>{self.links(r.randint(2, 7))}</ul></nav>",
            lambda: f"<header><p>{say(1, 4, '')}</p><nav>{self.links(4, 'p')}</nav></header>",
            lambda: f"<header {self.named('masthead', 'site-header')}><h1>{say(1, 3, '')}</h1><p>{say(3, 7)}</p></header>",
            lambda: f"<div {self.named('menu', 'navigation', 'topbar')}><ul>{self.links(5)}</ul></div>",
            lambda: f"<div {self.named('header', 'logo')}><p>{say(1, 4, '')}</p></div>",
            lambda: self.noise(),
        ))() for _ in range(r.randint(0, 3))]
        wrap = r.choice((
            "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class=post-content>{}</div>", "<div id=content><div class=entry>{}</div></div>", "<div class='story text'>{}</div>",
            "<main class=read-more>{}</main>", "<div class='content sidebar-right'><article>{}</article></div>", "<div id=wrap><div class=col>{}</div></div>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>",
        ))
        text = wrap.format(self.article())
        if wrap.startswith("<table") and r.random() < 0.7:
            text = text.replace("<tr>", f"<tr><td {self.named('menu', 'nav')}>{self.links(4, 'p')}</td>", 1)
        below = [f() for f in (self.comments, self.noise, lambda: f"<div {self.named('sidebar', 'side')}><h3>{say(1, 3, '')}</h3><p>{say(4, 30)}</p><ul>{self.links(3)}</ul></div>") if r.random() < 0.35]
        foot = r.choice((lambda: f"<footer><p>&copy; {say(1, 5)}</p></footer>", lambda: f"<footer><ul>{self.links(3)}</ul><p>{say(3, 20)}</p></footer>", lambda: f"<div id=footer><p>{say(3, 9)}</p></div>", lambda: f"<footer>&copy; 2021 {say(1, 3, '')}</footer>", lambda: ""))()
        inner = "".join(top) + text + "".join(below) + foot
        around = r.choice(("{}", "{}", "{}", "<form id=aspnetForm>{}</form>", "<div class=page-with-sidebar>{}</div>", "<div id=wrapper class='logged-in header-fixed'>{}</div>", "<div><div>{}</div></div>"))
        body = r.choice(("", "", " class=has-sidebar", " class='logged-in login'", " id=story", " class='single post-template comments-open'"))
        return f"<html><head><title>T</title></head><body{body}>{around.format(inner)}</body></html>"


_LONG = "A long sentence of the story that tells, with some detail, what happened on that day and why it mattered to them."
#: Labelled pages that are written out; MARK stands before the article's blocks.
PAGES = (
    f"<header class='site-header'><p>Daily paper</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div id=cookie-notice><p>We use cookies to improve this site, as told in our long policy on cookies and data.</p></div><main><article><h1>{MARK}A day out</h1><p>{MARK}{_LONG}</p><p>{MARK}{_LONG}</p><aside class=related><p>More of this kind, picked for you by our editors.</p></aside><h2>{MARK}Later</h2><p>{MARK}{_LONG}</p></article></main><section class=comments><p>{_LONG}</p></section><form><p>Your name</p></form><footer><p>&copy; The paper</p></footer>",
    f"<div class=menu><p><a href=/a>News</a></p></div><div class=banner><p>Buy one now and get another one at half of the price.</p></div><div class='post-content'><h1>{MARK}On bread</h1><p>{MARK}{_LONG}</p><ul><li>{MARK}Flour and salt</li><li>{MARK}Water, warm</li></ul><blockquote>{MARK}{_LONG}</blockquote><div class=ad><p>Sponsored: the best oven of this year is here.</p></div><p>{MARK}{_LONG}</p></div><div class=comment><p>{_LONG}</p></div><div id=reply><p>{_LONG}</p></div><div class=sidebar><p><a href=/x>Most read</a></p></div><div id=footer><p>All rights reserved.</p></div>",
    f"<article><header><h1>{MARK}Rain</h1></header><p>{MARK}{_LONG}</p><table><tr><td>{MARK}12 mm</td></tr></table><div class=share><p><a href=/s>Share</a></p></div><p>{MARK}{_LONG}</p><div class=newsletter><p>Subscribe to our letter and never miss what is new.</p></div><div class=comments><p>{_LONG}</p></div></article><aside><p>Weather today</p></aside><footer><p>&copy; 2020</p></footer>",
)


def labelled(page: str) -> tuple[list[list[int]], list[int]]:
    """Features and labels of the blocks of a page whose article is marked."""
    labels = [int(MARK in b.text) for b in blocks(page)]
    found = [b.features for b in blocks(page.replace(MARK, ""))]
    return found, labels


@dataclass
class Field:
    """Weights of a chain of two labels: of each feature for label 1, of the steps between labels, of the first label."""

    unary: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    def decode(self, page: list[list[int]]) -> list[int]:
        if not page:
            return []
        u = [float(self.unary[f].sum()) for f in page]
        (aa, ab), (ba, bb) = self.steps.tolist()
        s0, s1 = self.first[0], self.first[1] + u[0]
        back = []
        for x in u[1:]:
            from0, from1 = s1 + ba > s0 + aa, s1 + bb > s0 + ab
            back.append((from0, from1))
            s0, s1 = (s1 + ba if from0 else s0 + aa), (s1 + bb if from1 else s0 + ab) + x
        label = int(s1 > s0)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps (Adam), the expectations from the forward-backward recursion over all pages at once."""
    pages = [p for p in pages if p[0]]
    n, long = len(pages), max(len(p[0]) for p in pages)
    x, y, there = np.zeros((n, long, len(FEATURES)), np.float32), np.zeros((n, long), int), np.zeros((n, long), bool)
    for i, (found, labels) in enumerate(pages):
        for t, f in enumerate(found):
            x[i, t, f] = 1
        y[i, : len(labels)], there[i, : len(labels)] = labels, True
    size = len(FEATURES)
    w = np.zeros(size + 6)
    m, v = np.zeros_like(w), np.zeros_like(w)
    pair_there = there[:, 1:]
    seen = np.concatenate([np.einsum("ntf,nt->f", x, y * there), [((y[:, :-1] == a) & (y[:, 1:] == b) & pair_there).sum() for a in (0, 1) for b in (0, 1)], [(y[:, 0] == a).sum() for a in (0, 1)]])
    for k in range(1, rounds + 1):
        u = np.stack([np.zeros((n, long)), x @ w[:size]], axis=2)
        steps, first = w[size : size + 4].reshape(2, 2), w[size + 4 :]
        fwd, bwd = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        fwd[:, 0] = first + u[:, 0]
        for t in range(1, long):
            new = np.logaddexp.reduce(fwd[:, t - 1, :, None] + steps, axis=1) + u[:, t]
            fwd[:, t] = np.where(there[:, t, None], new, fwd[:, t - 1])
        for t in range(long - 2, -1, -1):
            new = np.logaddexp.reduce(steps + (u[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(there[:, t + 1, None], new, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None])[:, :, 1] * there
        pair = np.exp(fwd[:, :-1, :, None] + steps + (u[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair_there[:, :, None, None]
        start = np.exp(fwd[:, 0] + bwd[:, 0] - z[:, None]).sum(axis=0)
        grad = (seen - np.concatenate([np.einsum("ntf,nt->f", x, p), pair.sum(axis=(0, 1)).reshape(-1), start])) / n - decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(w[:size], w[size : size + 4].reshape(2, 2), w[size + 4 :])


@functools.lru_cache(maxsize=2)
def learn(pages: tuple[str, ...] = (), composed: int = LEARN_PAGES, rounds: int = ROUNDS) -> Field:
    """Trains on PAGES, on composed pages, and on further labelled pages (MARK before the article's blocks)."""
    composer = _Composer(1)
    made = [composer.page() for _ in range(composed)]
    return train([labelled(p) for p in (*PAGES, *made, *pages)], rounds)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row. Null and empty html give an empty text; repeated rows are all returned.

    Pages of any length are read whole, in time in proportion to it; an empty table gives no rows; other columns of pages are
    left aside.
    """
    pages = pages.select("page_id", "url", "html")
    field = field or learn()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = []
                for page in part.column(2).to_pylist():
                    found = blocks(page or "")
                    texts.append("\n\n".join(x.text for x, y in zip(found, field.decode([x.features for x in found]), strict=True) if y))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
