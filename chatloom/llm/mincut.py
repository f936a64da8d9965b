"""Main text of web pages by a minimum cut.

A page is read into blocks of text. A linear classifier turns what is known of a
block (its containers, their names, its length and links) into log-odds of being
content; the two negative log-likelihoods are its terminal capacities. Neighbours
in page order and in the document tree are tied by edges that weaken with their
distance in the tree. The minimum cut labels all blocks of a page together.

Left out before the cut are tags, comments and what stands in script, style, title
and iframe. All other text is in a block, also where it is hidden, a fallback or in a
drawing: these are features of the classifier.

Null or empty html gives an empty text. Repeated rows are pages each. Broken
markup is read as far as it goes; unclosed elements end with their container. An
open head ends nothing, as all in it but text of the page is left out anyway.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, types as T

from .common import carried, texts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: no markup inside; only textarea has text of the page
RAW = frozenset("script style title iframe textarea".split())
#: may stand within a line: text inside makes blocks of its own, the line goes on afterwards
INSETS = frozenset("svg object canvas noscript template select".split())
_NAME = re.compile(r"[a-z]+")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset(("hr",))
#: an open element of the second kind ends where one of the first begins
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset(BLOCKS) - {"button", "label", "option"}
#: what cannot stand directly in an inset ends it
_ENDS_INSET = {
    "svg": BLOCKS | frozenset("b big br center code em embed font i img nobr s small span strike strong sub sup tt u var".split()),
    "select": BLOCKS - {"option", "hr", "button", "legend", "div"},
}

#: log-odds of content
WEIGHTS = {
    "bias": -1.0, "article": 4.0, "paragraph": 1.0, "heading": 0.5, "words": 0.35, "sentence": 0.5, "links": -4.0,
    "nav": -9.0, "footer": -9.0, "aside": -8.0, "header": -7.0, "form": -8.0, "good name": 1.5, "bad name": -9.0,
    "hidden": -7.0, "object": -2.0, "drawing": -9.0, "legal": -9.0,
}
GOOD_NAMES = frozenset("article content entry main post story body text".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form"
    " gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted related reply"
    " respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget"
    " discussion reactions replies responses thread threads".split()
)
#: names that say nothing where most of the page's text stands: a whole page in one form, a story in a box named promo
DOUBTFUL = frozenset("banner form header masthead modal notice popup promo promoted search share sharing social sponsored tags widget".split())
#: share of the text (that of plain boilerplate left out) from which a doubtful container is none
MOST = 0.5
_LEGAL = re.compile(r"(?:©|\(c\)|\bcopyright\b)\s*(?:©|\(c\))?\s*\d{4}|\ball rights reserved\b", re.IGNORECASE)
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "main": "article", "article": "article", "dialog": "aside", "alert": "aside"}
KINDS = {"nav": "nav", "menu": "nav", "footer": "footer", "aside": "aside", "header": "header", "form": "form", "fieldset": "form", "button": "form", "label": "form", "dialog": "aside", "article": "article", "main": "article"}
KINDS |= {"select": "form", "textarea": "form", "noscript": "hidden", "template": "hidden", "canvas": "hidden", "object": "object", "svg": "drawing"}
#: smoothness between neighbours in page order and under one parent
ADJACENT, SIBLING = 0.6, 0.8


@dataclass
class Element:
    tag: str
    depth: int
    parent: Element | None
    #: its own signs, without those of its ancestors
    kinds: frozenset = frozenset()
    good: bool = False
    bad: bool = False
    doubtful: bool = False


@dataclass(frozen=True)
class Signs:
    """What all containers of a block say together."""

    kinds: frozenset = frozenset()
    good: bool = False
    bad: bool = False


@dataclass
class Block:
    at: Element
    text: str
    linked: int
    score: float = field(default=0.0)


def _element(tag: str, attrs: str, parent: Element) -> Element:
    kinds: set[str] = set()
    good = bad = doubtful = False
    kind = KINDS.get(tag)
    if kind:
        kinds.add(kind)
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words = set(_NAME.findall(value))
            good = good or (tag not in ("body", "html") and bool(words & GOOD_NAMES))
            # a body or article named after its template is no notice
            if tag not in ("body", "html", "article", "main"):
                bad = bad or bool(words & (BAD_NAMES - DOUBTFUL))
                doubtful = doubtful or bool(words & DOUBTFUL)
        elif name == "role" and value in ROLES:
            kinds.add(ROLES[value])
        elif tag in ("body", "html"):
            continue  # hidden until a script has run
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            kinds.add("hidden")
    return Element(tag, parent.depth + 1, parent, frozenset(kinds), good, bad, doubtful)


def _signs(blocks: list[Block]) -> list[Signs]:
    """Signs of each block: those of its containers, doubtful ones only where they hold less than most of the text."""
    plain: dict[int, bool] = {0: False}
    size: dict[int, int] = {}
    total = 0

    def boilerplate(e: Element | None) -> bool:
        if e is None:
            return False
        if id(e) not in plain:
            plain[id(e)] = e.bad or bool(e.kinds & {"nav", "footer", "aside", "drawing"}) or boilerplate(e.parent)
        return plain[id(e)]

    for b in blocks:
        if boilerplate(b.at):
            continue
        chars = len(b.text) - b.linked
        total += chars
        e: Element | None = b.at
        while e is not None:
            if e.doubtful or "form" in e.kinds:
                size[id(e)] = size.get(id(e), 0) + chars
            e = e.parent
    known: dict[int, Signs] = {}

    def of(e: Element | None) -> Signs:
        if e is None:
            return Signs()
        if id(e) not in known:
            above = of(e.parent)
            most = size.get(id(e), 0) >= MOST * total and total > 0
            kinds = e.kinds
            if "header" in kinds and "article" in above.kinds | kinds - {"header"}:
                kinds = kinds - {"header"}  # heads the article itself
            if most:
                kinds = kinds - {"form"}
            known[id(e)] = Signs(above.kinds | kinds, above.good or e.good, above.bad or e.bad or (e.doubtful and not most))
        return known[id(e)]

    return [of(b.at) for b in blocks]


def read_blocks(page: str) -> list[Block]:
    """Blocks of text in page order."""
    at = Element("", 0, None)
    out: list[Block | None] = []
    pieces: list[str] = []
    linked, in_link = 0, False
    slot: int | None = None  # place of a line that an inset interrupted
    held: list[tuple] = []  # open insets and the lines around them
    last_end: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked, slot
        raw = "".join(pieces)
        pieces.clear()
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            block = Block(at, text, min(linked, len(text)))
            if slot is None:
                out.append(block)
            else:
                out[slot] = block
        linked, slot = 0, None

    def enter(node: Element) -> None:
        nonlocal at, pieces, linked, slot
        if slot is None and any(map(str.strip, pieces)):
            slot = len(out)
            out.append(None)
        held.append((node, at, pieces, linked, in_link, slot))
        at, pieces, linked, slot = node, [], 0, None

    def leave(depth: int) -> None:
        """Insets from this depth on end."""
        nonlocal at, pieces, linked, in_link, slot
        while held and held[-1][0].depth >= depth:
            flush()
            _, at, pieces, linked, in_link, slot = held.pop()

    def ends_after(tag: str, place: int) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.IGNORECASE)), default=-1)
        return last_end[tag] >= place

    last, end = 0, page.rfind(">") + 1  # what opens a tag behind the last ">" is text
    while m := _TOKEN.search(page, last, end):
        if m.start() > last:
            piece = page[last : m.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece.strip())
        last = m.end()
        tag = m["tag"]
        if tag is None:
            if last == end and page.startswith("<!--", m.start()) and not m[0].endswith("-->"):
                last = len(page)  # an open comment
            continue
        tag = tag.lower()
        if held and at is held[-1][0] and tag in _ENDS_INSET.get(at.tag, ()):
            leave(at.depth)
        if tag in RAW:
            if m["end"]:
                continue
            if ends_after(tag, last):
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, last)
                inner, last = page[last : stop.start()], stop.end()
            else:  # code goes on to the end of the page, other text to the next tag
                stop = -1 if tag in ("script", "style") else page.find("<", last)
                inner, last = page[last:stop] if stop >= 0 else page[last:], stop if stop >= 0 else len(page)
            if tag == "textarea":
                enter(_element(tag, m["attrs"], at))
                pieces.append(inner)
                leave(at.depth)
        elif tag == "br":
            pieces.append(" ")
        elif tag == "annotation":  # of a formula, whose text stands in its line
            pieces.append(" ")
        elif tag == "a":
            in_link = not m["end"]
        elif tag in INSETS:
            if m["end"]:
                node = next((h[0] for h in reversed(held) if h[0].tag == tag), None)
                if node is not None:
                    leave(node.depth)
            elif not m["attrs"].endswith("/") and ends_after(tag, last):
                enter(_element(tag, m["attrs"], at))
        elif tag in BLOCKS:
            if m["end"]:
                node = at
                while node.parent is not None and node.tag != tag:
                    node = node.parent
                if node.parent is not None:
                    leave(node.depth)
                flush()
                in_link = False
                if node.parent is not None:
                    at = node.parent
                continue
            flush()
            in_link = False
            if tag not in _VOID:
                if tag in _ENDS_P and at.tag == "p":
                    at = at.parent
                if at.tag in _CLOSES.get(tag, ()):
                    at = at.parent
                at = _element(tag, m["attrs"], at)
    if last < len(page):
        pieces.append(page[last:])
    leave(0)
    flush()
    return [b for b in out if b is not None]


def log_odds(b: Block, signs: Signs) -> float:
    """Linear classifier of one block."""
    w = WEIGHTS
    s = w["bias"] + sum(w[k] for k in signs.kinds)
    s += w["good name"] * signs.good + w["bad name"] * signs.bad
    s += w["paragraph"] * (b.at.tag in ("p", "pre", "blockquote")) + w["heading"] * (b.at.tag[:1] == "h" and b.at.tag[1:].isdigit())
    s += w["words"] * min(8.0, math.log2(1 + b.text.count(" "))) + w["sentence"] * (b.text[-1] in ".!?…\"”»")
    # a legal line that the article itself holds is part of it
    s += w["legal"] * ("article" not in signs.kinds and len(b.text) < 200 and bool(_LEGAL.search(b.text)))
    return s + w["links"] * b.linked / len(b.text)


def _distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges to the next block and to the next one under the same parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, ADJACENT * 0.5 ** max(0, _distance(blocks[i - 1].at, b.at) - 2)))
        parent = id(b.at.parent)
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, SIBLING))
        last[parent] = i
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut.

    Flow straight through a node is taken at once; the rest moves along shortest
    paths, level by level, from nodes with source capacity left to those with sink
    capacity left.
    """
    n = len(source)
    give = [max(0.0, a - b) for a, b in zip(source, sink, strict=True)]
    take = [max(0.0, b - a) for a, b in zip(source, sink, strict=True)]
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[float] = []
    for a, b, c in edges:
        near[a].append(len(to))
        to.append(b)
        cap.append(c)
        near[b].append(len(to))
        to.append(a)
        cap.append(c)
    tiny = 1e-9
    while True:
        level = [0 if g > tiny else -1 for g in give]
        queue = deque(i for i in range(n) if level[i] == 0)
        while queue:
            i = queue.popleft()
            for e in near[i]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not any(level[i] >= 0 and take[i] > tiny for i in range(n)):
            return [x >= 0 for x in level]
        tried = [0] * n
        for s in range(n):
            while give[s] > tiny and level[s] == 0:
                path: list[int] = []
                i = s
                while take[i] <= tiny:
                    step = None
                    while tried[i] < len(near[i]):
                        e = near[i][tried[i]]
                        if cap[e] > tiny and level[to[e]] == level[i] + 1:
                            step = e
                            break
                        tried[i] += 1
                    if step is not None:
                        path.append(step)
                        i = to[step]
                    elif path:
                        i = to[path.pop() ^ 1]
                        tried[i] += 1
                    else:
                        break
                if take[i] <= tiny:
                    break
                flow = min([give[s], take[i], *(cap[e] for e in path)])
                give[s] -= flow
                take[i] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def main_text(page: str | None) -> str:
    """Text of the blocks on the content side, one line each."""
    blocks = read_blocks(page or "")
    if not blocks:
        return ""
    source, sink = [], []
    for b, signs in zip(blocks, _signs(blocks), strict=True):
        b.score = log_odds(b, signs)
        # negative log-likelihood of the label that the cut would give it
        source.append(math.log1p(math.exp(min(b.score, 30.0))))
        sink.append(math.log1p(math.exp(min(-b.score, 30.0))))
    keep = minimum_cut(source, sink, ties(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, column: str = "html", columns: list[str] | None = None) -> DataFrame:
    """``row`` (columns of the input) and ``out`` (``text``, ``n_chars``)."""

    def run(batch):
        out = [main_text(p) for p in texts(batch, "__text")]
        return {"text": out, "n_chars": [len(t) for t in out]}

    return carried(pages, column, EXTRACTED, run, columns=columns)
