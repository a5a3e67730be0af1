"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log1p
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import text_of

#: A path is content if its fused ratio reaches this share of the text-weighted mean.
SHARE = 0.35
#: Weights of a leaf and its neighbours when ratios are smoothed.
KERNEL = (0.25, 0.5, 0.25)

#: A quote left open does not hide the end of its tag.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?:^|\s)(hidden)(?=\s|/|$)""")
WORD = re.compile("[a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")

#: Elements whose content is text, not markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others part blocks.
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp
small span strike strong sub sup time tt u var wbr""".split())
#: An opening tag closes these, if open, up to the nearest element that holds them.
CLOSES = {tag: frozenset(closed.split()) for tag, closed in (
    ("li", "li p"), ("dt", "dt dd p"), ("dd", "dt dd p"), ("tr", "tr td th p"), ("td", "td th p"), ("th", "td th p"), ("option", "option"),
    ("tbody", "tr td th tbody thead p"), ("tfoot", "tr td th tbody thead p"), ("body", "head"))}
HOLDS = frozenset("ul ol dl table select body html div section article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that are never the main text.
ASIDE_TAGS = frozenset("""head nav footer aside form script style noscript template button select textarea iframe object svg canvas
dialog menu fieldset""".split())
#: Words of a class, id or role that mark what surrounds the main text.
ASIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion
sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert
popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations
widget widgets toolbar search pagination pager complementary contentinfo dialog""".split())
#: The same where no article holds it: an article may have a header of its own.
HEADER_WORDS = frozenset("header".split())
REMARK_WORDS = frozenset("comment comments disqus replies respond reviews".split())
CONTENT_TAGS = frozenset("article main".split())


class Node(NamedTuple):
    path: int  # number of the root-to-here path of labels
    tag: str
    aside: bool
    around: int  # number of the nearest article or main element, or -1
    place: int  # number of the element, 0 for the page


class Leaf(NamedTuple):
    path: int
    parent: int  # path of the block's parent
    content: int  # number of the content element around it, or -1
    tag: str
    text: str
    linked: int  # characters inside links
    place: int  # number of the block's element


class Element(NamedTuple):
    up: int  # number of the element that holds it, or -1
    tag: str
    path: int


def leaves(page: str) -> tuple[list[Leaf], list[Element]]:
    """The blocks of text outside of what is never content, in page order, and all elements by number."""
    paths: dict[tuple[int, str], int] = {}
    parents: list[int] = [-1]
    stack = [Node(0, "", False, -1, 0)]
    elements = [Element(-1, "", 0)]
    out: list[Leaf] = []
    pieces: list[str] = []
    linked, in_link = 0, False
    opened: Counter[str] = Counter()

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].aside:
            text = unescape(text)
            pieces.append(text)
            linked += in_link and len(text.strip())

    def leave(depth: int) -> None:
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    def enter(node: Node) -> None:
        opened[node.tag] += 1
        stack.append(node)

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            top = stack[-1]
            if text:
                out.append(Leaf(top.path, parents[top.path], top.around, top.tag, text, min(linked, len(text)), top.place))
            pieces.clear()
        linked = 0

    at = 0
    while True:
        found = TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        closing, tag, rest = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag:
            continue
        if tag == "br":
            if pieces:
                pieces.append(" ")
            continue
        if tag in RAW:
            if not closing and not rest.endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            if not closing and tag not in VOID and _aside(tag, rest, stack[-1]):
                close_block()
                enter(Node(stack[-1].path, tag, True, stack[-1].around, stack[-1].place))
            elif closing and stack[-1].tag == tag:
                leave(-1)
            continue
        close_block()
        in_link = False
        if closing:
            if opened[tag]:
                leave(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in VOID:
            continue
        while stack[-1].tag == "p" or stack[-1].tag in HEADINGS and tag in HEADINGS:
            leave(-1)
        closes = CLOSES.get(tag, ())
        for i in range(len(stack) - 1, 0, -1) if any(opened[c] for c in closes) else ():
            if stack[i].tag in closes:
                leave(i)
            elif stack[i].tag in HOLDS:
                break
        if rest.endswith("/") and tag not in CONTENT_TAGS:
            continue
        top = stack[-1]
        key = top.path, f"{tag}.{_names(rest)}"
        if key not in paths:
            paths[key] = len(parents)
            parents.append(top.path)
        place = len(elements)
        elements.append(Element(top.place, tag, paths[key]))
        around = place if tag in CONTENT_TAGS or 'role="main"' in rest else top.around
        enter(Node(paths[key], tag, top.aside or _aside(tag, rest, top), around, place))
    close_block()
    return out, elements


def _names(rest: str) -> str:
    return " ".join(v or w or x for n, v, w, x, _ in ATTRIBUTE.findall(rest) if n.lower() == "class") if "class" in rest else ""


def _aside(tag: str, rest: str, top: Node) -> bool:
    if tag in ASIDE_TAGS:
        return True
    inside = top.around >= 0
    if tag == "header" and not inside:
        return True
    if not rest or tag in ("html", "body"):
        return False
    words = set()
    for name, a, b, c, hidden in ATTRIBUTE.findall(rest):
        if hidden or name.lower() == "aria-hidden" and (a or b or c) == "true":
            return True
        if name.lower() in ("class", "id", "role"):
            words.update(WORD.findall((a or b or c).lower()))
    if words & REMARK_WORDS:
        return True
    if tag in CONTENT_TAGS:
        return False
    return bool(words & ASIDE_WORDS) or not inside and bool(words & HEADER_WORDS)


def fused_ratios(blocks: list[Leaf]) -> dict[int, float]:
    """Per path: text and punctuation per leaf of the path, less link text, smoothed along the page and fused."""
    total: dict[int, list[int]] = {}
    for leaf in blocks:
        own = total.setdefault(leaf.path, [0, 0, 0, 0])
        for i, n in enumerate((len(leaf.text), len(PUNCTUATION.findall(leaf.text)), leaf.linked, 1)):
            own[i] += n
    ratio = {path: log1p(text / n) * (1 + log1p(marks / n)) * (1 - links / text) for path, (text, marks, links, n) in total.items()}
    series = [ratio[leaf.path] for leaf in blocks]
    padded = [series[0], *series, series[-1]]
    sums: dict[int, list[float]] = {}
    for leaf, *near in zip(blocks, padded, padded[1:], padded[2:]):
        sums.setdefault(leaf.path, []).append(sum(w * v for w, v in zip(KERNEL, near)))
    return {path: sum(v) / len(v) for path, v in sums.items()}


def main_text(page: str) -> str:
    """The blocks of the main text, one per line.

    Paths at or above the threshold select nodes. The article and main elements that hold
    selected blocks and the rest of the page compete by fused ratio times characters of
    their selected blocks. If the elements have as much, they are the main text, whole.
    Else the rest is, with those elements whose mean ratio reaches SHARE of its own: see
    _of_rest.
    """
    blocks, elements = leaves(page)
    if not blocks:
        return ""
    fused = fused_ratios(blocks)
    limit = SHARE * _mean(blocks, fused)
    chosen = {path for path, value in fused.items() if value >= limit}
    held = {b.content for b in blocks if b.path in chosen and b.content >= 0}
    rest = [b for b in blocks if b.path in chosen and b.content < 0]
    if held and _weight(rest, fused) <= _weight([b for b in blocks if b.path in chosen and b.content >= 0], fused):
        return "\n".join(b.text for b in blocks if b.content in held)
    inside: dict[int, list[Leaf]] = {c: [] for c in held}
    for b in blocks:
        if b.content in held:
            inside[b.content].append(b)
    stay = {c for c, own in inside.items() if _mean(own, fused) >= SHARE * _mean(rest, fused)}
    kept = _of_rest(blocks, elements, fused, chosen)
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep or b.content in stay)


def _weight(blocks: list[Leaf], fused: dict[int, float]) -> float:
    return sum(fused[b.path] * len(b.text) for b in blocks)


def _mean(blocks: list[Leaf], fused: dict[int, float]) -> float:
    return _weight(blocks, fused) / sum(len(b.text) for b in blocks)


def _of_rest(blocks: list[Leaf], elements: list[Element], fused: dict[int, float], chosen: set[int]) -> list[bool]:
    """Which blocks are main text where no article or main element holds it.

    Everything from the first to the last selected block stays: lists, tables and quotes
    have other paths than the paragraphs around them. Before and after it, what is not
    mostly links (headings aside) stays if it shares a parent path with a selected block, or
    lies inside an element whose path holds a fair share of the selected text.
    """
    picked = [b.path in chosen and b.content < 0 for b in blocks]
    first, last = picked.index(True), len(blocks) - 1 - picked[::-1].index(True)
    rest = [b for b, pick in zip(blocks, picked) if pick]
    parents = {b.parent for b in rest}
    holding = {e.up for e in elements}
    weight: Counter[int] = Counter()
    holders = {}
    for b in rest:
        # a block's element holds the text around it, or else its parent does; the whole page is no such element
        place = b.place if b.place in holding else elements[b.place].up
        if place > 0 and elements[place].tag not in ("html", "body"):
            holders[place] = elements[place].path
            weight[elements[place].path] += fused[b.path] * len(b.text)
    fair = SHARE * max(weight.values(), default=0)
    within = [False] * len(elements)
    for place, element in enumerate(elements):
        within[place] = element.up >= 0 and within[element.up] or place in holders and weight[holders[place]] >= fair
    return [first <= i <= last or b.content < 0 and (b.parent in parents or within[b.place]) and (b.tag in HEADINGS or b.linked * 2 <= len(b.text))
            for i, b in enumerate(blocks)]


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; nothing is shuffled.

    The whole page is read, whatever its length. A null or empty page, or one without
    content, has empty text. Null ids and urls and repeated rows stay as given.
    """
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select("page_id", "url", text_of(html_col).alias("html")).mapInArrow(_extracted, schema)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


#: For pages whose main text is one article element of headings and paragraphs. These references
#: count without their semicolon too, as HTML has it.
SQL = r"""
WITH article AS (SELECT page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS body FROM pages),
block AS (SELECT page_id, i, regexp_replace(regexp_replace(b, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS b
          FROM (SELECT page_id, regexp_split_to_array(body, '</?(?:p|h[1-6]|div|ul|li|section)(?:\s[^>]*)?>') AS bs FROM article),
               unnest(bs) WITH ORDINALITY AS u(b, i)),
plain AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b,
          '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', chr(39), 'g'), '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS b FROM block),
joined AS (SELECT page_id, string_agg(b, chr(10) ORDER BY i) AS text FROM plain WHERE b <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM article LEFT JOIN joined USING (page_id)
"""
