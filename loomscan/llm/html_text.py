"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into blocks at block-level tags, in one forward scan. Each block has its word count and link density, those of
the blocks before and after it, whether a heading of the page came before it, and the same of its group: all blocks in the
nearest enclosing container, with the share of the page's words outside links that they hold. Two weaker features say what the nearest element hints at that bears a hint, by its
kind or by a whole class name: page furniture, or an article. The tree over these numbers is grown here, at import, from
LABELLED, a small table of pages whose blocks were labelled by hand; pages marked as plain count a second time without hints,
so that a hint decides only where the numbers don't.

Defined results: null and empty pages have an empty text; a tag, comment or raw element that never closes ends the page, an
attribute's quote that never closes is an ordinary character, and cut off references are read as far as they go; repeated rows
are read each; an empty table gives no rows; other columns are kept by extract() except for those named like the added ones,
which are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomscan.llm.common import lots

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_HINTED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_UNSEEN = re.compile(r"(?:^|[\s\"'/])(?:hidden(?=[\s=/]|$)|style\s*=\s*[\"']?[^\"']*display\s*:\s*none|aria-hidden\s*=\s*[\"']?true)", re.I)
# Elements by what they do to text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
HIDDEN = {"template", "head", "svg", "object", "select", "button", "canvas", "audio", "video", "map", "math"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Containers whose blocks make a group.
GROUPS = {"article", "aside", "body", "center", "dialog", "div", "fieldset", "footer", "form", "header", "main", "menu", "nav", "section", "td"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
ARTICLE = {"article", "main"}
# Class names, ids and roles, as whole words in lower case.
FURNITURE_NAMES = set("ad ads advert advertisement advertising banner sponsor sponsored promo cookie cookies cookie-notice cookie-banner cookie-consent consent notice popup modal nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar widget widgets footer site-footer site-header masthead comment comments comment-list commentlist discussion disqus disqus_thread replies respond share sharing share-buttons social related related-posts recommended recommendations newsletter subscribe signup login search searchform toolbar pagination pager copyright legal contentinfo complementary skip-link".split())
ARTICLE_NAMES = set("article post entry story content body main post-content entry-content article-body article-content main-content post-body story-body".split())

FEATURES = ["words", "link_density", "words_before", "links_before", "words_after", "links_after", "group_words", "group_links", "group_share", "furniture", "article", "heading", "led"]


@dataclass
class Block:
    """Text of a block, its words and those in links, its group, what is hinted (-1 furniture, 1 article), and whether it is a heading."""

    text: str
    words: int
    linked: int
    group: int
    hint: int
    heading: int


def features(words: list[int], linked: list[int], groups: list[int], hints: list[int], headings: list[int], parents: list[int]) -> list[tuple]:
    """The features of the blocks of one page, in the order of FEATURES. parents: the group that encloses each group, itself for the outermost."""
    total, links = [0] * len(parents), [0] * len(parents)
    for n, k, g in zip(words, linked, groups, strict=True):
        total[g] += n
        links[g] += k
    for g in range(len(parents) - 1, 0, -1):  # a group comes after the one that encloses it
        if parents[g] != g:
            total[parents[g]] += total[g]
            links[parents[g]] += links[g]
    page = max(sum(words) - sum(linked), 1)
    density = [k / n for n, k in zip(words, linked, strict=True)]
    out, lead = [], headings.index(1) if 1 in headings else 0  # without a heading all blocks count as led
    for i, g in enumerate(groups):
        before = (words[i - 1], density[i - 1]) if i else (0, 0.0)
        after = (words[i + 1], density[i + 1]) if i + 1 < len(words) else (0, 0.0)
        own = total[g] - links[g]
        out.append((words[i], density[i], *before, *after, own, links[g] / total[g], own / page, int(hints[i] < 0), int(hints[i] > 0), headings[i], int(i >= lead)))
    return out


#: Pages labelled by hand. A page: whether it is plain, and its blocks as (group, words, words in links, hint, heading, label).
#: A group's name begins with that of the group that encloses it; label 1 is main text.
LABELLED = [
    # an article with paragraphs of all lengths, between a menu, an advert and a footer
    (True, [("bn", 1, 1, -1, 0, 0), ("bn", 1, 1, -1, 0, 0), ("bn", 2, 2, -1, 0, 0), ("bx", 12, 0, -1, 0, 0), ("ba", 8, 0, 1, 1, 1), ("ba", 60, 0, 1, 0, 1), ("ba", 3, 0, 1, 0, 1), ("ba", 120, 4, 1, 0, 1), ("ba", 1, 0, 1, 0, 1), ("ba", 45, 0, 1, 0, 1), ("ba", 2, 0, 1, 0, 1), ("bf", 9, 0, -1, 0, 0)]),
    (True, [("bn", 1, 1, -1, 0, 0), ("bn", 2, 2, -1, 0, 0), ("bn", 1, 1, -1, 0, 0), ("bx", 24, 0, -1, 0, 0), ("ba", 5, 0, 1, 1, 1), ("ba", 1, 0, 1, 0, 1), ("ba", 2, 0, 1, 0, 1), ("ba", 30, 0, 1, 0, 1), ("ba", 5, 0, 1, 1, 1), ("ba", 80, 0, 1, 0, 1), ("bf", 3, 0, -1, 0, 0), ("bf", 4, 3, -1, 0, 0)]),
    # text before the first heading
    (True, [("bn", 1, 1, -1, 0, 0), ("bn", 1, 1, -1, 0, 0), ("ba", 55, 0, 1, 0, 1), ("ba", 20, 0, 1, 0, 1), ("ba", 4, 0, 1, 1, 1), ("ba", 72, 0, 1, 0, 1), ("ba", 5, 0, 1, 1, 1), ("ba", 33, 0, 1, 0, 1), ("bf", 7, 0, -1, 0, 0)]),
    (True, [("bn", 1, 1, -1, 0, 0), ("bx", 22, 0, -1, 0, 0), ("ba", 3, 0, 1, 0, 1), ("ba", 90, 2, 1, 0, 1), ("ba", 6, 0, 1, 1, 1), ("ba", 41, 0, 1, 0, 1), ("bf", 12, 0, -1, 0, 0)]),
    (False, [("bn", 1, 1, -1, 0, 0), ("ba", 9, 0, 1, 0, 1), ("ba", 12, 0, 1, 0, 1), ("ba", 2, 0, 1, 1, 1), ("ba", 15, 0, 1, 0, 1), ("bf", 12, 0, -1, 0, 0)]),
    (True, [("ba", 28, 0, 1, 0, 1), ("ba", 1, 0, 1, 0, 1), ("ba", 110, 0, 1, 0, 1), ("ba", 2, 0, 1, 1, 1), ("ba", 30, 0, 1, 0, 1)]),
    # a paragraph that is one link is text, a list of links in the article isn't, nor what is nested in it as furniture
    (False, [("bn", 1, 1, -1, 0, 0), ("bn", 1, 1, -1, 0, 0), ("ba", 7, 0, 1, 1, 1), ("ba", 50, 5, 1, 0, 1), ("ba", 14, 14, 1, 0, 1), ("ba", 66, 0, 1, 0, 1), ("ba", 3, 3, 1, 0, 1), ("ba", 40, 0, 1, 0, 1), ("bas", 30, 0, -1, 0, 0), ("bas", 4, 4, -1, 0, 0), ("ba", 35, 0, 1, 0, 1), ("ba", 4, 4, 1, 0, 0), ("ba", 5, 5, 1, 0, 0), ("ba", 3, 3, 1, 0, 0), ("ba", 6, 6, 1, 0, 0), ("bf", 12, 1, -1, 0, 0)]),
    (False, [("ba", 6, 0, 1, 1, 1), ("ba", 90, 0, 1, 0, 1), ("ban", 1, 1, -1, 0, 0), ("ban", 2, 2, -1, 0, 0), ("ba", 25, 0, 1, 0, 1), ("ba", 20, 20, 1, 0, 1), ("ba", 71, 0, 1, 0, 1), ("bas", 8, 0, -1, 0, 0), ("ba", 10, 0, 1, 0, 1), ("baf", 3, 0, -1, 0, 0), ("baf", 9, 0, -1, 0, 0)]),
    # readers' comments and sidebars, as long as paragraphs
    (False, [("bh", 4, 1, -1, 0, 0), ("ba", 9, 0, 1, 1, 1), ("ba", 70, 0, 1, 0, 1), ("ba", 110, 3, 1, 0, 1), ("ba", 22, 0, 1, 0, 1), ("bc", 2, 0, -1, 1, 0), ("bc", 36, 0, -1, 0, 0), ("bc", 2, 1, -1, 0, 0), ("bc", 81, 0, -1, 0, 0), ("bc", 17, 0, -1, 0, 0), ("bs", 3, 0, -1, 1, 0), ("bs", 45, 0, -1, 0, 0), ("bf", 7, 3, -1, 0, 0)]),
    (False, [("bn", 1, 1, -1, 0, 0), ("ba", 5, 0, 1, 1, 1), ("ba", 14, 0, 1, 0, 1), ("ba", 9, 0, 1, 0, 1), ("bc", 40, 0, -1, 0, 0), ("bc", 25, 0, -1, 0, 0), ("bs", 16, 0, -1, 0, 0), ("bf", 3, 0, -1, 0, 0)]),
    (False, [("bm", 12, 0, -1, 0, 0), ("bm", 20, 2, -1, 0, 0), ("ba", 2, 0, 1, 0, 1), ("ba", 1, 0, 1, 0, 1), ("bs", 12, 0, -1, 0, 0)]),
    (False, [("bh", 6, 1, -1, 0, 0), ("bn", 1, 1, -1, 0, 0), ("bn", 1, 1, -1, 0, 0), ("bk", 6, 0, -1, 0, 0), ("bx", 7, 0, -1, 0, 0), ("ba", 3, 0, 1, 1, 1), ("ba", 7, 0, 1, 0, 1), ("ba", 2, 1, 1, 0, 1), ("bas", 4, 0, -1, 0, 0), ("ba", 1, 0, 1, 0, 1), ("baf", 1, 0, -1, 0, 0), ("bc", 14, 0, -1, 0, 0), ("bs", 17, 0, -1, 0, 0), ("bf", 6, 0, -1, 0, 0)]),
    # names that mislead: most of the page stands in an element that is called like furniture
    (False, [("bn", 1, 1, -1, 0, 0), ("bn", 2, 2, -1, 0, 0), ("ba", 6, 0, -1, 1, 1), ("ba", 75, 0, -1, 0, 1), ("ba", 4, 0, -1, 0, 1), ("ba", 130, 6, -1, 0, 1), ("ba", 52, 0, -1, 0, 1), ("bf", 8, 0, -1, 0, 0)]),
    (False, [("ba", 88, 0, -1, 0, 1), ("ba", 20, 0, -1, 0, 1), ("ba", 61, 0, -1, 0, 1), ("bf", 5, 4, -1, 0, 0)]),
    (False, [*[("bn", 1, 1, -1, 0, 0)] * 5, ("bx", 9, 0, -1, 0, 0), ("ba", 6, 0, -1, 1, 1), ("ba", 28, 0, -1, 0, 1), ("ba", 5, 0, -1, 0, 1), ("ba", 21, 0, -1, 0, 1), ("bf", 11, 0, -1, 0, 0)]),
    (False, [*[("bn", 1, 1, -1, 0, 0)] * 5, ("ba", 7, 0, 1, 1, 1), ("ba", 180, 0, 1, 0, 1), ("ba", 95, 0, 1, 0, 1), ("bc", 2, 0, -1, 1, 0), ("bc", 90, 0, -1, 0, 0), ("bc", 120, 0, -1, 0, 0), ("bc", 31, 0, -1, 0, 0), ("bf", 12, 0, -1, 0, 0)]),
    # and the menu in one that is called like an article
    (False, [("bn", 1, 1, 1, 0, 0), ("bn", 2, 2, 1, 0, 0), ("bn", 1, 1, 1, 0, 0), ("bn", 3, 3, 1, 0, 0), ("bx", 10, 0, 0, 0, 0), ("ba", 7, 0, 0, 1, 1), ("ba", 90, 0, 0, 0, 1), ("ba", 2, 0, 0, 0, 1), ("ba", 64, 0, 0, 0, 1), ("bf", 6, 0, 0, 0, 0)]),
    (True, [("bn", 1, 1, -1, 0, 0), ("bn", 1, 1, -1, 0, 0), ("bx", 31, 0, -1, 0, 0), ("ba", 8, 0, 1, 1, 1), ("ba", 22, 0, 1, 0, 1), ("ba", 1, 0, 1, 0, 1), ("ba", 6, 0, 1, 0, 1), ("bf", 9, 0, -1, 0, 0)]),
    (True, [("bn", 1, 1, -1, 0, 0), ("bn", 1, 1, -1, 0, 0), ("bx", 8, 0, -1, 0, 0), ("ba", 3, 0, 1, 1, 1), ("ba", 6, 0, 1, 0, 1), ("bf", 5, 0, -1, 0, 0)]),
    (True, [("bn", 1, 1, -1, 0, 0), ("bn", 1, 1, -1, 0, 0), ("bx", 18, 0, -1, 0, 0), ("ba", 1, 0, 1, 1, 1), ("ba", 1, 0, 1, 0, 1), ("bf", 7, 0, -1, 0, 0)]),
    (True, [("bn", 1, 1, -1, 0, 0), ("bn", 1, 1, -1, 0, 0), ("bx", 40, 0, -1, 0, 0), ("ba", 9, 0, 1, 1, 1), ("ba", 210, 0, 1, 0, 1), ("ba", 1, 0, 1, 0, 1), ("ba", 2, 0, 1, 0, 1), ("ba", 1, 0, 1, 0, 1), ("bf", 8, 0, -1, 0, 0)]),
    # articles shorter than what is around them
    (False, [*[("bn", 1, 1, -1, 0, 0)] * 6, ("bx", 10, 0, -1, 0, 0), ("ba", 3, 0, 1, 1, 1), ("ba", 3, 0, 1, 0, 1), ("bf", 16, 0, -1, 0, 0)]),
    (False, [*[("bn", 1, 1, -1, 0, 0)] * 5, ("bx", 7, 0, -1, 0, 0), ("ba", 7, 0, 1, 1, 1), ("ba", 7, 0, 1, 0, 1), ("bf", 13, 0, -1, 0, 0)]),
    (False, [*[("bn", 1, 1, -1, 0, 0)] * 6, ("bx", 11, 0, -1, 0, 0), ("ba", 2, 0, 1, 1, 1), ("ba", 8, 0, 1, 0, 1), ("bf", 2, 0, -1, 0, 0)]),
    (False, [*[("bn", 1, 1, -1, 0, 0)] * 6, ("bx", 21, 0, -1, 0, 0), ("ba", 1, 0, 1, 1, 1), ("ba", 1, 0, 1, 0, 1), ("bf", 30, 2, -1, 0, 0)]),
    (False, [*[("bn", 1, 1, -1, 0, 0)] * 4, ("bx", 15, 1, -1, 0, 0), ("ba", 5, 0, 1, 1, 1), ("ba", 12, 1, 1, 0, 1), ("ba", 2, 0, 1, 0, 1), ("bf", 14, 0, -1, 0, 0)]),
    (False, [("ba", 1, 0, 1, 1, 1), ("ban", 1, 0, -1, 0, 0), ("ba", 1, 0, 1, 0, 1)]),
    (False, [("ba", 5, 0, 1, 1, 1), ("ba", 40, 0, 1, 0, 1), ("ban", 2, 0, -1, 0, 0), ("ba", 30, 0, 1, 0, 1), ("baf", 6, 0, -1, 0, 0)]),
    # no hints at all: a container of text, paragraphs that each have a container of their own, and text right in the body
    (True, [("bn", 1, 1, 0, 0, 0), ("bn", 1, 1, 0, 0, 0), ("bx", 25, 1, 0, 0, 0), ("ba", 6, 0, 0, 1, 1), ("ba", 42, 0, 0, 0, 1), ("ba", 5, 0, 0, 0, 1), ("bad", 77, 2, 0, 0, 1), ("bad", 2, 0, 0, 0, 1), ("ba", 31, 0, 0, 0, 1), ("bf", 11, 4, 0, 0, 0)]),
    (True, [("bn", 2, 2, 0, 0, 0), ("bp", 55, 0, 0, 0, 1), ("bq", 55, 0, 0, 0, 1), ("bi", 1, 1, 0, 0, 0)]),
    (True, [("bn", 5, 5, 0, 0, 0), ("bh", 7, 0, 0, 1, 1), ("bp", 38, 0, 0, 0, 1), ("bq", 19, 0, 0, 0, 1), ("br", 64, 3, 0, 0, 1), ("bt", 47, 0, 0, 0, 1), ("bf", 4, 0, 0, 0, 0), ("bg", 3, 3, 0, 0, 0)]),
    (True, [("b", 1, 1, 0, 0, 0), ("b", 1, 1, 0, 0, 0), ("b", 1, 1, 0, 0, 0), ("b", 5, 0, 0, 1, 1), ("b", 48, 0, 0, 0, 1), ("b", 9, 0, 0, 0, 1), ("b", 33, 1, 0, 0, 1), ("b", 4, 4, 0, 0, 0)]),
    (True, [("b", 70, 0, 0, 0, 1), ("b", 3, 0, 0, 0, 1), ("b", 28, 0, 0, 0, 1)]),
    (True, [("b", 12, 0, 0, 0, 1)]),
    # short articles and verse
    (True, [("bn", 1, 1, -1, 0, 0), ("bn", 1, 1, -1, 0, 0), ("ba", 4, 0, 1, 1, 1), ("ba", 12, 0, 1, 0, 1), ("ba", 20, 0, 1, 0, 1), ("bf", 6, 0, -1, 0, 0)]),
    (True, [("bn", 3, 3, -1, 0, 0), ("ba", 6, 0, 1, 0, 1), ("ba", 5, 0, 1, 0, 1), ("ba", 7, 0, 1, 0, 1), ("ba", 6, 0, 1, 0, 1), ("ba", 4, 0, 1, 0, 1), ("bf", 2, 1, -1, 0, 0)]),
    # columns of a layout table
    (True, [("btl", 1, 1, 0, 0, 0), ("btl", 2, 2, 0, 0, 0), ("btl", 1, 1, 0, 0, 0), ("btm", 5, 0, 0, 1, 1), ("btm", 90, 2, 0, 0, 1), ("btm", 7, 0, 0, 0, 1), ("btm", 41, 0, 0, 0, 1), ("btr", 14, 10, 0, 0, 0), ("btr", 6, 6, 0, 0, 0)]),
    # pages of links have no main text
    (True, [("bn", 1, 1, -1, 0, 0), ("bl", 3, 0, 0, 1, 0), ("bl", 6, 6, 0, 0, 0), ("bl", 8, 8, 0, 0, 0), ("bl", 5, 5, 0, 0, 0), ("bl", 9, 7, 0, 0, 0), ("bl", 2, 0, 0, 1, 0), ("bl", 4, 4, 0, 0, 0), ("bf", 8, 2, -1, 0, 0)]),
    (True, [("bn", 2, 2, 0, 0, 0), ("bn", 2, 2, 0, 0, 0), ("bn", 5, 4, 0, 0, 0)]),
]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 9, least: int = 4):
    """A tree by the Gini index, with so many rows at least in a leaf: (feature, limit, at most, above), or a leaf's label."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] <= limit
            if min(left.sum(), (~left).sum()) < least:
                continue
            gini = sum(len(x) * x.mean() * (1 - x.mean()) for x in (labels[left], labels[~left]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, limit, left)
    if best is None:
        return bool(share >= 0.5)
    _, f, limit, left = best
    return f, float(limit), grow(rows[left], labels[left], depth - 1, least), grow(rows[~left], labels[~left], depth - 1, least)


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED, those of plain pages a second time without hints."""
    rows: list[tuple] = []
    labels: list[int] = []
    for plain, page in LABELLED:
        names = sorted({name[:i] for name, *_ in page for i in range(1, len(name) + 1)}, key=lambda n: (len(n), n))
        at = {n: i for i, n in enumerate(names)}
        parents = [at.get(n[:-1], i) for n, i in at.items()]
        name, words, linked, hints, headings, own = map(list, zip(*page, strict=True))
        for kept in (hints, [0] * len(hints))[: 1 + plain]:
            rows += features(words, linked, [at[n] for n in name], kept, headings, parents)
            labels += own
    return np.array(rows, dtype=float), np.array(labels, dtype=float)


@lru_cache(maxsize=1)
def tree():
    return grow(*labelled_rows())


def decide(row: tuple) -> bool:
    node = tree()
    while not isinstance(node, bool):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


class _Ends:
    """Where tags end, for one page: every place is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def tag(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at a place, or -1. Quotes that never close are ordinary characters."""
        if at > self.last[">"]:
            return -1
        while True:
            at = _PLAIN.match(self.page, at).end()
            if at >= len(self.page):
                return -1
            c = self.page[at]
            if c == ">":
                return at
            at = self.page.find(c, at + 1) + 1 if self.last[c] > at else at + 1


def _hint(name: str, attributes: str, inherited: int) -> int:
    """What an element hints at, or what is around it does."""
    tokens = {t for found in _HINTED.findall(attributes) for x in found if x for t in x.lower().split()}
    article, furniture = bool(tokens & ARTICLE_NAMES), bool(tokens & FURNITURE_NAMES)
    if article != furniture and name not in ("body", "html"):
        return 1 if article else -1
    if name in FURNITURE and not (name == "header" and inherited > 0):
        return -1
    return 1 if name in ARTICLE else inherited


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks with text, in page order, and the group that encloses each group."""
    found: list[Block] = []
    parents = [0]
    stack: list[tuple[str, int, int, int]] = []  # element, hidden, hint, group
    open_of: dict[str, int] = {}
    parts: list[str] = []
    linked: list[str] = []
    ends, size = _Ends(page), len(page)
    links = link_at = heading = at = 0  # link_at: how many elements were open where a link began

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                _, _, hint, group = stack[-1] if stack else ("", 0, 0, 0)
                found.append(Block(text, n, min(n, len(html.unescape("".join(linked)).split())), group, hint, heading))
            parts.clear()
        linked.clear()

    def put(text: str) -> None:
        if not (stack and stack[-1][1]):
            parts.append(text)
            if links:
                linked.append(text)

    def pop() -> None:
        nonlocal links
        open_of[stack.pop()[0]] -= 1
        if len(stack) < link_at:  # a link that was left open ends with the element it began in
            links = 0

    while at < size:
        start = page.find("<", at)
        if start < 0:
            put(page[at:])
            break
        m = _NAME.match(page, start + 1)
        if m is None and page[start + 1 : start + 2] not in ("!", "?", "/"):
            if start + 1 < size:
                put(page[at : start + 1])
            else:  # a tag that is cut off before its name
                put(page[at:start])
            at = start + 1
            continue
        if start > at:
            put(page[at:start])
        if m is None:  # comments and the like
            comment = page.startswith("<!--", start)
            end = page.find("-->", start + 4) if comment else page.find(">", start)
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        closing, name = m[1], m[2].lower()
        end = ends.tag(m.end())
        if end < 0:
            break
        attributes, at = page[m.end() : end], end + 1
        if name in RAW:
            close()
            if not closing and not attributes.endswith("/"):
                m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if m is None:
                    break
                end = page.find(">", m.end())
                at = end + 1 if end >= 0 else size
            continue
        if name == "br":
            put(" ")
            continue
        if name == "a":
            links, link_at = 0 if closing else 1, len(stack)
            put("")
            linked.append(" ")
            continue
        if name not in BLOCKS and name not in HIDDEN:
            continue
        close()
        if closing:
            if name in HEADINGS:
                heading = 0
            if open_of.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        heading = int(name in HEADINGS)
        if name == "hr" or attributes.endswith("/") and name in VOID:
            continue
        if name == "body":
            stack.clear()
            open_of.clear()
        while stack and stack[-1][0] == "p":  # a paragraph ends where the next block begins
            pop()
        _, hidden, inherited, group = stack[-1] if stack else ("", 0, 0, 0)
        hint = _hint(name, attributes, inherited)
        if name in GROUPS and not (name == "header" and inherited > 0):
            parents.append(group)
            group = len(parents) - 1
        stack.append((name, int(hidden or name in HIDDEN or bool(_UNSEEN.search(attributes))), hint, group))
        open_of[name] = open_of.get(name, 0) + 1
    close()
    return found, parents


def main_text(page: str | None) -> str:
    """The blocks of main text, joined by blank lines."""
    found, parents = blocks(page or "")
    rows = features([b.words for b in found], [b.linked for b in found], [b.group for b in found], [b.hint for b in found], [b.heading for b in found], parents)
    return "\n\n".join(b.text for b, row in zip(found, rows, strict=True) if decide(row))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of pages without the html, with text: the main text of each page."""
    source = pages.drop(*[c for c in ("text",) if c != html_col])
    names = [c for c in source.columns if c != html_col]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            texts = [main_text(x) for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, type=pa.string())], names=[*names, "text"])

    return source.mapInArrow(run, f"{kinds}{', ' * bool(kinds)}text string")
