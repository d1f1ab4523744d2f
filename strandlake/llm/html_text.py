"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks of text at block-level tags. A block has a word
count and a link density, those of its neighbours before and after, and what the
*nearest* enclosing element that says anything says of itself (element name,
class, id and role words): part of an article, of what surrounds it, or of the
page's header. A menu inside an article is a menu, and a page without such
elements is decided by words and links alone. A class name that only holds a
telling word among others is weak evidence and overrules no element. A decision
tree decides which blocks are main text. It is trained, here, on the small
labelled table that :mod:`strandlake.llm.html_labels` holds.

Everything is done page by page, in one pass over the whole html.

Edge cases: null html counts as empty and gives an empty text; unclosed tags,
unclosed comments and truncated pages are read as far as they go; repeated rows
are extracted each; an empty table gives an empty result; extra columns do no
harm.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import only

#: Element names by their role in a page.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
DROPPED = frozenset("noscript template svg math iframe object select button canvas audio video map".split())
CHROME = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that mark what surrounds an article, those that mark the article, and those that say nothing beside them.
CHROME_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline captcha comment comments commentlist cookie cookies consent copyright disclaimer discussion disqus "
    "donate feedback footer footnav gdpr header login masthead menu menus meta modal nav navbar navigation newsletter notice notification notices opinions overlay pager pagination paywall popup privacy promo "
    "promos promoted promotion rail reactions recommended recommendations register related replies reply respond responses reviews search share sharing sidebar sidebars signin signup skip skyscraper social sponsor sponsored sponsors "
    "subscribe subscription tagcloud tags talkback teaser toc toolbar topbar trending widget widgets alert".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent post postbody story text".split())
PLAIN_WORDS = frozenset(
    "area author bar block blocks body bottom box btn button buttons card cards container content col column entry footer form global group icons inline inner item items left link links list lower main message "
    "more module nav news outer page panel pane post posts primary reader readers right row secondary section site slot stories story top text title unit upper user users wrap wrapper".split()
)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_content", "in_chrome", "weak_word", "heading", "list_item")

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    flags: tuple


#: What the nearest telling element makes of a block.
NONE, CONTENT_ZONE, CHROME_ZONE, FORM_ZONE, HEADER_ZONE = range(5)


def _name_hint(value: str) -> tuple[bool, bool, bool]:
    """(chrome, content, weak) of a class or id value. A name marks chrome if all its other words are known; otherwise it is weak."""
    chrome = content = weak = False
    for token in value.split():
        parts = [p.lower() for p in _PART.findall(token)] or [token.lower()]
        whole = token.lower().replace("-", "").replace("_", "")
        if whole in CHROME_WORDS or any(p in CHROME_WORDS for p in parts):
            if whole in CHROME_WORDS or all(p in CHROME_WORDS or p in CONTENT_WORDS or p in PLAIN_WORDS for p in parts):
                chrome = True
            else:
                weak = True
        elif whole in CONTENT_WORDS or any(p in CONTENT_WORDS for p in parts):
            content = True
    return chrome, content, weak


@lru_cache(4096)
def _hints(attributes: str) -> tuple[bool, bool, bool, bool, str]:
    """(chrome, content, weak, main role, label) of an opening tag's attributes; label is the training mark, if any."""
    chrome = content = weak = main = False
    label = ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            x, y, z = _name_hint(value)
            chrome, content, weak = chrome or x, content or y, weak or z
        elif name == "role":
            chrome |= value.lower() in ROLES
            main |= value.lower() == "main"
            content |= value.lower() in CONTENT
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            chrome = True
        elif name == "data-label":
            label = value
    return chrome, content, weak, main, label


def _zone(name: str, up: int, chrome: bool, content: bool, main: bool) -> int:
    """What an element makes of its blocks, inside an element that made ``up`` of them."""
    if name == "main" or main:
        return CONTENT_ZONE
    if chrome:
        return CHROME_ZONE
    if name in CHROME:
        return FORM_ZONE if name in ("form", "fieldset") else CHROME_ZONE
    if name == "article":
        return up if up == CHROME_ZONE else CONTENT_ZONE
    if content:
        return up if up in (CHROME_ZONE, FORM_ZONE) else CONTENT_ZONE
    if name == "header" and up == NONE:
        return HEADER_ZONE
    return up


def blocks(page: str | None) -> list[tuple[Block, str]]:
    """Flat text blocks of a page in order, each with its training label ('' on ordinary pages)."""
    page = page or ""
    out: list[tuple[Block, str]] = []
    # (name, zone, weak word, heading, list item, label, dropped) of all open elements
    stack: list[tuple] = []
    root = state = ("", NONE, False, False, False, "", False)
    text: list[str] = []
    linked: list[str] = []
    anchors = 0

    def close() -> None:
        if text:
            flat = " ".join(html.unescape("".join(text)).split())
            if flat:
                n, zone = flat.count(" ") + 1, state[1]
                flags = (zone == CONTENT_ZONE, zone in (CHROME_ZONE, FORM_ZONE, HEADER_ZONE), state[2] and zone == NONE, *state[3:5])
                out.append((Block(flat, n, min(n, len(html.unescape(" ".join(linked)).split())), flags), state[5]))
            text.clear()
            linked.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece and not state[6]:
            text.append(piece)
            if anchors:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name in RAW and not closing:
            # contents are no text: go on behind the end tag, or at the end of the page
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in DROPPED or state[6]:
            # no text inside, and no block ends there: inner elements only count as open, with the flags around them
            if not closing:
                if name not in VOID and not m[0].endswith("/>"):
                    stack.append((name, *state[1:6], True))
            elif any(s[0] == name for s in stack):
                at_name = max(i for i, s in enumerate(stack) if s[0] == name)
                if name in BLOCK or name in DROPPED or not any(s[0] in BLOCK or s[0] in DROPPED for s in stack[at_name:]):
                    after = stack[at_name - 1] if at_name else root
                    if name in BLOCK and not after[6]:  # the end of a block around an unclosed one
                        close()
                        anchors = 0
                    del stack[at_name:]
            state = stack[-1] if stack else root
            continue
        if name == "a":
            anchors = max(0, anchors - 1) if closing else anchors + 1
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in BLOCK:
            if name in VOID or m[0].endswith("/>"):
                continue
            if closing:  # ends the innermost element of its name, but no block
                i = len(stack) - 1
                while i >= 0 and stack[i][0] not in BLOCK and stack[i][0] != name:
                    i -= 1
                if i >= 0 and stack[i][0] == name:
                    after = stack[i - 1] if i else root
                    if after[1] != state[1]:
                        close()
                    del stack[i:]
                    state = after
                continue
            chrome = _hints(m[3] or m[6] or "")[0]
            if chrome and state[1] != CHROME_ZONE:  # an inline element that is an advert, a share link and the like: a block of its own
                close()
            stack.append((name, CHROME_ZONE if chrome else state[1], *state[2:]))
            state = stack[-1]
            continue
        close()
        anchors = 0
        if closing:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID:
            # a new paragraph or item ends an open one
            i = len(stack) - 1
            while i >= 0 and stack[i][0] not in BLOCK:
                i -= 1
            if i >= 0 and (stack[i][0] == "p" and name != "p" or name in ("p", "li", "dt", "dd") and stack[i][0] == name):
                del stack[i:]
            up = stack[-1] if stack else root
            chrome, content, weak, main, label = _hints(m[3] or m[6] or "")
            # an element that says what it is, or a telling word of its own, starts anew
            zone = _zone(name, up[1], chrome, content, main) if name not in ("body", "html") else NONE
            stack.append((name, zone, weak or up[2], name in HEADINGS, up[4] or name == "li", label or up[5], False))
        state = stack[-1] if stack else root
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row per block, in the order of FEATURES."""
    n = len(found)
    words = np.array([0, *[b.words for b in found], 0], float)
    density = np.array([0, *[b.linked / b.words for b in found], 0], float)
    own = np.array([b.flags for b in found], float).reshape(n, 5)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], own])


class Tree:
    """A binary decision tree (Gini impurity), fitted on a small table."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2):
        self.nodes: list[tuple] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, float(y.mean()) if len(y) else 0.0, 0, 0))
        best = (1e-9, -1, 0.0)
        total = len(y) * y.mean() * (1 - y.mean()) if len(y) else 0
        if depth and total > 0:
            for k in range(x.shape[1]):
                order = np.argsort(x[:, k], kind="stable")
                v, s = x[order, k], np.cumsum(y[order])
                n = np.arange(1, len(y))
                cut = np.flatnonzero((v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least))
                if not len(cut):
                    continue
                nl, sl = n[cut], s[cut]
                nr, sr = len(y) - nl, s[-1] - sl
                gain = total - (sl * (nl - sl) / nl + sr * (nr - sr) / nr)
                g = int(np.argmax(gain))
                if gain[g] > best[0] + 1e-12:
                    best = (float(gain[g]), k, float((v[cut[g]] + v[cut[g] + 1]) / 2))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            a, b = self._grow(x[left], y[left], depth - 1, least), self._grow(x[~left], y[~left], depth - 1, least)
            self.nodes[at] = (best[1], best[2], self.nodes[at][2], a, b)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of main text in the leaf of every row."""
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            k, cut, value, a, b = self.nodes[at]
            if k < 0:
                out[rows] = value
            elif len(rows):
                left = x[rows, k] <= cut
                todo += [(a, rows[left]), (b, rows[~left])]
        return out


@lru_cache(1)
def default_tree() -> Tree:
    """The tree of the labelled table."""
    from .html_labels import PAGES

    x, y = [], []
    for page in PAGES:
        found = blocks(page)
        x.append(features([b for b, _ in found]))
        y += [label == "main" for _, label in found]
    return Tree(np.concatenate(x), np.array(y, float))


def described(tree: Tree | None = None) -> str:
    """The tree in words, one node a line."""
    tree, lines = tree or default_tree(), []

    def walk(at: int, depth: int) -> None:
        k, cut, share, a, b = tree.nodes[at]
        if k < 0:
            lines.append(f"{'  ' * depth}{'main' if share >= 0.5 else 'other'} ({share:.2f})")
            return
        lines.append(f"{'  ' * depth}{FEATURES[k]} <= {cut:g}:")
        walk(a, depth + 1)
        lines.append(f"{'  ' * depth}{FEATURES[k]} > {cut:g}:")
        walk(b, depth + 1)

    walk(0, 0)
    return "\n".join(lines)


def main_text(page: str | None, tree: Tree | None = None) -> str:
    found = [b for b, _ in blocks(page)]
    if not found:
        return ""
    keep = (tree or default_tree()).predict(features(found)) >= 0.5
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    tree = tree or default_tree()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h, tree) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].array, "url": b["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    return only(pages, "page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
