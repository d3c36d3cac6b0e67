"""HTML extraction (operator 4): minimum-cut labelling of a page's text blocks.

A page is cut into blocks of text at block elements. A linear classifier over a block's place, links and words gives
its log-odds of being content: the capacity of its link to the source (content) or the sink (boilerplate). Blocks that
follow each other, and blocks that stand near each other in the tree, are joined by smoothness edges. The minimum cut,
found by maximum flow, labels every block: doubtful blocks go with their neighbours.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.token_counts import slices

NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
ENDING = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text never shows, or belongs to a control; the first group's content is raw text.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
UNSEEN = frozenset((*RAW, "head", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "button", "select", "option", "datalist", "label", "input"))
#: An opening tag that ends an open element of the given kinds, up to the given containers.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Log-odds of the classifier.
TAG = {"p": 1.5, "h1": 1.5, "h2": 1.0, "h3": 1.0, "h4": 0.8, "h5": 0.5, "h6": 0.5, "blockquote": 1.5, "pre": 1.5, "figcaption": 0.5, "li": 0.0, "dd": 0.5, "td": 0.0, "summary": 0.3}
APART = {"nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "fieldset": -9.0, "dialog": -9.0, "menu": -9.0, "search": -9.0}
ROLE = {"navigation": -9.0, "banner": -9.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "dialog": -9.0, "alertdialog": -9.0, "alert": -6.0, "menu": -9.0, "menubar": -9.0, "form": -9.0, "main": 3.0, "article": 3.0}
NAMED_AGAINST = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar sidebar side rail aside footer foot cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login signin register social share sharing related recommended recommendations trending popular comment comments commentlist disqus reply replies respond discussion breadcrumb breadcrumbs pagination pager popup modal overlay toolbar widget widgets copyright legal disclaimer masthead skip paywall donate download".split())
NAMED_FOR = frozenset("article content entry post story main text body prose".split())
#: Names that begin so tell what a page is about, not what a part of it is for.
ABOUT = frozenset(("category", "tag"))
HEADER = frozenset(("header", "head", "top", "topbar", "site"))
SMALL_PRINT = re.compile(r"©|\ball rights reserved\b|\bcopyright\b", re.I)
BIAS, LINKS, LONG, SENTENCE, SHORT, PRINT = -1.2, -5.0, 0.9, 0.6, -0.8, -2.0
ADJACENT, NEAR = 2.0, 1.0
UNIT = 1000


@dataclass
class Element:
    """An open element. ``block``: itself, if it is one of BLOCK or the root, or else the nearest one around it; blocks have
    the block around them as ``parent`` and their depth among blocks."""

    name: str
    parent: Element | None = None
    depth: int = 0
    odds: float = 0.0
    inside: bool = False
    hidden: bool = False
    block: Element | None = None


@dataclass
class Block:
    text: str
    home: Element
    tag: str
    odds: float
    linked: float


class Stack:
    """The open elements, with the places of each name, so that none is searched for."""

    def __init__(self, root: Element):
        self.open, self.places = [root], {}

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.open))
        self.open.append(element)

    def pop(self) -> Element:
        last = self.open.pop()
        self.places[last.name].pop()
        return last

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            self.pop()

    def last(self, names) -> int:
        """The place of the innermost open element of some names; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, stop, name, closes, attributes) of each tag, in order; comments and declarations have no name.

    A quote after an equals sign hides what it holds up to the next one of its kind. A tag that such quotes keep open to the
    page's end ends at its first >, and from there on quotes hide nothing; without any > the page's end cuts it off. Every
    character is looked at a bounded number of times.
    """
    at, quoted, end = 0, True, page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        sign = page[start + 1 : start + 2]
        if start > end and (sign in ("/", "!", "?") and sign or sign.isascii() and sign.isalpha()):
            yield start, len(page), "", False, ""
            return
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        m = NAME.match(page, start)
        if m is None:
            at = start + 1
            if sign in ("!", "?") and sign:
                at = page.find(">", start) + 1
                yield start, at, "", False, ""
            continue
        stop = _tag_end(page, m.end()) if quoted else page.find(">", m.end())
        if stop < 0 and quoted:
            quoted = False
            stop = page.find(">", m.end())
        at = stop + 1
        more = yield start, at, m[2].lower(), bool(m[1]), page[m.end() : stop]
        if more is not None:
            at = more
            yield None


def _tag_end(page: str, at: int) -> int:
    """Where the > of a tag stands that no quote hides; -1 if there is none."""
    while m := ENDING.search(page, at):
        if m[0] == ">":
            return m.start()
        if page[: m.start()].endswith("=") if m.start() < 64 else page[m.start() - 64 : m.start()].rstrip().endswith("="):
            at = page.find(m[0], m.end()) + 1
            if not at:
                return -1
        else:
            at = m.end()
    return -1


def _element(name: str, attributes: str, parent: Element) -> Element:
    out = Element(name, parent.block, parent.block.depth + 1, parent.odds, parent.inside, name in UNSEEN or parent.hidden)
    out.block = out if name in BLOCK else parent.block
    odds = APART.get(name, 0.0)
    if name in ("article", "main"):
        odds, out.inside = 3.0, True
    elif name == "header" and not out.inside:
        odds = -9.0
    if attributes.strip(" /"):
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        role = values.get("role", "").lower()
        odds += ROLE.get(role, 0.0)
        out.inside |= role in ("main", "article")
        style = values.get("style", "").replace(" ", "").lower()
        if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style:
            out.hidden = True
        if name not in ("html", "body"):
            names = [[p.lower() for p in PART.findall(n)] for n in (values.get("class", "") + " " + values.get("id", "")).split()]
            named = {p for parts in names if parts and parts[0] not in ABOUT for p in parts}
            whole = name in ("article", "main") or role in ("main", "article")  # what it is says more than what it is called
            if not whole and (named & NAMED_AGAINST or named & HEADER and not out.inside and name not in ("h1", "h2")):
                odds -= 9.0
            elif named & NAMED_FOR:
                odds += 1.5
    out.odds = max(-20.0, min(out.odds + odds, 4.0) if odds > 0 else out.odds + odds)
    return out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order, with white space made plain and character references decoded."""
    root = Element("")
    root.block = root
    stack, found = Stack(root), []
    held: list[str] = []
    linked = at = 0

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                top = stack.open[-1]
                found.append(Block(text, top.block, top.block.name, top.odds, min(1.0, linked / max(1, len(text)))))
        held.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack.open[-1].hidden:
            held.append(raw)
            if any(e.name == "a" for e in stack.open[-4:]):
                linked += len(" ".join(raw.split()))

    found_tags = tokens(page)
    for start, stop, name, closes, attributes in found_tags:
        say(page[at:start])
        at = stop
        if not name:
            continue
        if closes:
            if place := stack.last((name,)):
                if name in BLOCK:
                    close()
                stack.cut(place)
            elif name in ("p", "br"):
                close() if name == "p" else held.append(" ")
            continue
        if name == "br" or name == "wbr":
            held.append(" " if name == "br" else "")
            continue
        if name in BLOCK:
            close()
            while stack.open[-1].name == "p" or stack.open[-1].name not in BLOCK and len(stack.open) > 1 and stack.last(("p",)):
                stack.pop()  # a block ends an open paragraph
            kinds, bounds = ENDS.get(name, ((), ()))
            if (place := stack.last(kinds)) > stack.last(bounds):
                stack.cut(place)
        if name in VOID:
            continue
        element = _element(name, attributes, stack.open[-1])
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            found_tags.send(at)
        elif not (attributes.endswith("/") and name in ("svg", "path")):
            stack.push(element)
    say(page[at:])
    close()
    return found


def gain(block: Block) -> float:
    """The classifier: a block's log-odds of being content."""
    words = block.text.count(" ") + 1
    out = BIAS + TAG.get(block.tag, 0.0) + block.odds + LINKS * block.linked + LONG * min(4.0, math.log2(1 + words / 8))
    if block.text[-1] in ".!?:;\"”»…":
        out += SENTENCE
    elif words < 4:
        out += SHORT
    if words < 40 and SMALL_PRINT.search(block.text):
        out += PRINT
    return out


def apart(a: Element, b: Element) -> int:
    """The steps from one block element to another by way of the tree: no more than tags stand between them."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness: each block with the one before it, weaker the farther apart in the tree, and with the last one before
    it under the same parent, or else the same grandparent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, round(UNIT * ADJACENT / (1 + apart(found[i - 1].home, b.home)))))
        above = [id(e) for e in (b.home, b.home.parent) if e is not None]
        for e in above:
            if (j := last.get(e, i - 1)) < i - 1:
                out.append((j, i, round(UNIT * NEAR)))
                break
        for e in above:
            last[e] = i
    return out


def min_cut(gains: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """The nodes on the source's side of a minimum cut: gains > 0 are capacities from the source, < 0 to the sink, links
    have one capacity both ways. Maximum flow by blocking flows in layered graphs."""
    n = len(gains)
    out: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for i, j, w in links:
        out[i].append(len(to))
        out[j].append(len(to) + 1)
        to += [j, i]
        room += [w, w]
    supply, demand = [max(g, 0) for g in gains], [max(-g, 0) for g in gains]
    while True:
        level = [0 if s else -1 for s in supply]
        queue = [i for i in range(n) if supply[i]]
        met = False
        for v in queue:
            met = met or demand[v] > 0
            for arc in out[v]:
                if room[arc] and level[to[arc]] < 0:
                    level[to[arc]] = level[v] + 1
                    queue.append(to[arc])
        if not met:
            return [x >= 0 for x in level]
        nexts = [0] * n
        for s in [i for i in range(n) if supply[i]]:
            path: list[int] = []
            v = s
            while supply[s]:
                if demand[v]:
                    flow = min(supply[s], demand[v], *(room[a] for a in path))
                    supply[s] -= flow
                    demand[v] -= flow
                    for a in path:
                        room[a] -= flow
                        room[a ^ 1] += flow
                    path, v = [], s
                elif nexts[v] < len(out[v]):
                    arc = out[v][nexts[v]]
                    if room[arc] and level[to[arc]] == level[v] + 1:
                        path.append(arc)
                        v = to[arc]
                    else:
                        nexts[v] += 1
                elif path:
                    v = to[path.pop() ^ 1]
                    nexts[v] += 1
                else:
                    break


def main_text(page: str) -> list[str]:
    """The content blocks of a page, in order."""
    found = blocks(page)
    content = min_cut([round(UNIT * gain(b)) for b in found], edges(found))
    return [b.text for b, keep in zip(found, content, strict=True) if keep]


def extract_main(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text (content blocks joined by two line feeds), n_chars, n_blocks, for every row of ``df``.

    The whole page is read and nothing capped. A null or empty page, or one without content, gives an empty text; nulls
    in ``keep`` stay; repeated rows each get their row; an empty table gives no rows; other columns are not read.
    """
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, len(keep)):
                texts = [main_text(t or "") for t in batch.column(len(keep)).to_pylist()]
                joined = ["\n\n".join(t) for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(joined, pa.string()), pa.array(map(len, joined), pa.int64()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars", "n_blocks"])

    source = df.select(*(F.col(c).alias(n) for n, c in zip(names, keep, strict=True)), F.col(html_col).cast("string").alias("__html"))
    out = source.mapInArrow(run, f"{schema}, text string, n_chars long, n_blocks long")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "text", "n_chars", "n_blocks")
