"""Main-text extraction by tag-path ratios.

A page becomes a sequence of text blocks, each with the path of tags (and first classes) from the root to
its block element; inline tags belong to the block around them, and the cells of a table or the items of a
list have the path of their table or list, which is the node that they count for. For each path the
length of text outside links and the punctuation are aggregated and divided by the number of nodes; the
two ratios are fused, a heading takes half its ratio from what it heads, and the ratios are smoothed along the
page. Blocks whose smoothed ratio reaches a threshold derived from the page's spread are content.
Subtrees that declare themselves boilerplate (tags, roles, whole class names) have no ratio. Paths in an
element that declares itself the article get a bonus on their ratio of the page's threshold at most: whole
where they hold the page's highest ratio, none where theirs is half of it.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<(?:(/)?([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(!--)|[!?/][^>]*+>)"
)
_BARE = re.compile(r"<(/)?([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。、，！？]")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}

# What declares boilerplate or content.
SKIPPED = frozenset("nav footer aside form button select option dialog menu object canvas audio video head".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion "
    "sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer copyright comment "
    "comments replies reply disqus respond discussion notice notices cookie cookies consent gdpr alert popup modal "
    "overlay newsletter subscribe subscription signup login signin register share sharing social related "
    "recommended recommendations widget widgets pagination pager toolbar topbar search skip".split()
)
#: Words that say nothing in a class name: a name declares boilerplate if it has a cue and else only these.
PLAIN = frozenset(
    "site page post article main global js block box wrap wrapper container content area section slot zone unit panel "
    "holder placeholder group list item items row col column inner outer top bottom left right primary secondary button "
    "buttons btn link links icon icons text form title head header body bar strip module region the and us a large small".split()
)
HEAD_TAGS = frozenset("base basefont bgsound head link meta".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text counts for the list or table that they are in.
PARTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "caption": ("table",)}
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_CUES = frozenset("article articlebody maincontent postcontent entrycontent storybody".split())


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), a or b or c)
    return out


def _declares(tag: str, raw: str, inside: bool) -> tuple[bool, bool, str]:
    """(boilerplate, article, first class) of an element; ``inside``: within an article already."""
    skip = tag in SKIPPED or tag == "header" and not inside
    main = tag in ARTICLE_TAGS
    label = ""
    if raw and not raw.isspace():
        attrs = _attrs(raw)
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
        label = "." + names[0] if names else ""
        if tag not in ("html", "body"):
            for name in names:
                words = [w for w in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", name) if w]
                low = [w.lower() for w in words]
                if any(w in CUES for w in low) and all(w in CUES or w in PLAIN or w.isdigit() for w in low):
                    skip = True
                if low and low[-1] == "header" and not inside:
                    skip = True
                if "".join(low) in ARTICLE_CUES:
                    main = True
            role = attrs.get("role", "").lower()
            skip = skip or role in SKIPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "") == "true"
            skip = skip or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            main = main or role in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
    return skip, main and not skip, label


class Block(NamedTuple):
    text: str
    path: int  # of the block's tag path, numbered by first appearance on the page
    node: int  # that the block counts for: its list or table, or itself
    skip: bool
    article: bool
    heading: bool
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """Every block in page order, references decoded. Time and memory are linear in the page."""
    out: list[Block] = []
    paths: dict[tuple[int, str], int] = {}
    # element: tag, path, node, boilerplate, in article
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    links = linked = nodes = 0
    at, end, last = 0, len(page), page.rfind(">")

    def push(tag: str, path: int, node: int, skip: bool, article: bool) -> None:
        stack.append((tag, path, node, skip, article))
        opened[tag] += 1

    def cut(i: int) -> None:
        for e in stack[i:]:
            opened[e[0]] -= 1
        del stack[i:]

    def flush() -> None:
        nonlocal linked, nodes
        if buffer:
            text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                if stack[-1][0] == "head":  # text ends the head
                    cut(len(stack) - 1)
                tag, path, node, skip, article = stack[-1]
                nodes += 1
                out.append(Block(text, path, node or -nodes, skip, article, tag in HEADINGS, min(linked, len(text))))
        linked = 0

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            buffer.append(page[at:lt])
            if links:
                linked += lt - at
        if lt == end:
            break
        if lt > last:  # nothing closes a tag from here on
            buffer.append(page[lt:])
            break
        m = _TAG.match(page, lt) or _BARE.match(page, lt)
        if m is None:
            buffer.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m.re is _TAG and m[4]:
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and tag in RAW:
            close = _closing(tag).search(page, at)
            at = end if close is None else close.end()
            gt = page.find(">", at)
            at = end if gt < 0 else gt + 1
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            if closing:
                if not opened[tag]:
                    continue
            elif not opened[tag] and not (m[3] and _declares(tag, m[3], stack[-1][4])[0]):
                continue
            # an inline element that is boilerplate is set apart, with those of its name inside it
        flush()
        if closing:
            if opened[tag]:
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if stack[-1][0] == "head" and tag not in HEAD_TAGS:  # its end tag may be left out
            cut(len(stack) - 1)
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    cut(i)
                    break
                if stack[i][0] in ("table", "td", "button", "object"):
                    break
        if tag in SIBLINGS:
            same, scope = SIBLINGS[tag]
            if any(opened[t] for t in same):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in same:
                        cut(i)
                        break
                    if stack[i][0] in scope:
                        break
        if tag in VOID or m[3].endswith("/") and tag not in CLOSES_P:
            continue
        _, path, node, skipped, inside = stack[-1]
        skip, article, label = _declares(tag, m[3], inside)
        if tag in ("ul", "ol", "menu", "dl", "table"):
            nodes += 1
            node = nodes
        elif tag in INLINE or tag in ("tr", "tbody", "thead", "tfoot") or tag in PARTS and node:
            pass
        else:
            node = 0
        if not (node and (tag in PARTS or tag in ("tr", "tbody", "thead", "tfoot"))) and tag not in INLINE:
            path = paths.setdefault((path, tag + label), len(paths) + 1)
        push(tag, path, node, skipped or skip, inside or article)
    flush()
    return out


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def select(page: str, spread: float = 0.55, radius: int = 2, trust: float = 1.0) -> list[str]:
    """Texts of the content blocks of a page, by tag-path ratios.

    ``trust`` scales the bonus of declared articles; with 0 the ratios stand alone.
    """
    every = [b for b in blocks(page) if not b.skip]
    n = len(every)
    if not n:
        return []
    names: dict[int, int] = {}
    path = np.fromiter((names.setdefault(b.path, len(names)) for b in every), np.int64, n)
    length = np.fromiter((len(b.text) - b.linked for b in every), np.float64, n)
    punct = np.fromiter((len(_PUNCT.findall(b.text)) if b.linked < len(b.text) else 0 for b in every), np.float64, n)
    nodes = np.bincount([names[p] for p, _ in {(b.path, b.node) for b in every}])
    fused = np.log1p(np.bincount(path, length) / nodes) * (1 + np.bincount(path, punct) / nodes)
    unit = np.cumsum([k > 0 and b.node != every[k - 1].node for k, b in enumerate(every)])
    first = np.flatnonzero(np.diff(unit, prepend=-1))  # the page as a sequence of nodes
    m = len(first)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / (radius / 2)) ** 2)
    weight = np.convolve(np.ones(m), kernel, "full")[radius : radius + m]
    headings = [k for k in range(m - 2, -1, -1) if every[first[k]].heading]

    def smoothed() -> tuple[np.ndarray, np.ndarray, float]:
        own = fused[path[first]]
        for k in headings:  # from the last, so that a heading of a heading sees what is below both
            own[k] = max(own[k], (own[k] + own[k + 1]) / 2)
        smooth = np.convolve(own, kernel, "full")[radius : radius + m] / weight
        return own, smooth, spread * (smooth.mean() + smooth.std()) if smooth.std() > 0 else 0.0

    own, smooth, threshold = smoothed()
    flagged = np.bincount(path, np.fromiter((b.article for b in every), np.float64, n)) / np.bincount(path)
    if trust and flagged.any():  # teasers and summaries may be declared articles too: the ratios say how far to trust it
        fused = fused + trust * flagged * (fused > 0) * threshold * max(0.0, 2 * fused[flagged > 0].max() / max(fused.max(), 1e-9) - 1)
        own, smooth, threshold = smoothed()
    # smoothing brings in what stands between content; what has next to no ratio of its own stays out
    kept = (smooth >= threshold) & (own > 0.05 * threshold)
    return [b.text for b, k in zip(every, unit.tolist()) if kept[k]]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Null or empty html, and pages without content, give the empty text. White space inside a block
    becomes one space, blocks are joined by one space in page order. Rows that repeat stay; other columns
    are not read. One pass without a shuffle; time and memory are linear in a page.
    """

    def run(batches):
        for b in batches:
            texts = [" ".join(select(html)) if html else "" for html in (x.as_py() for x in b.column(2))]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
