"""Main text of HTML pages from flat text blocks.

A page is read once, from left to right, in time linear in its length, and cut
into flat blocks at block-level tags.  Each block has its word count and link
density, those of the blocks before and after, and a few facts about the elements
around it.  A decision tree, grown here by Gini impurity from the labelled pages
of :mod:`scrubwell.llm.html_layouts`, says which blocks belong to the article.

Defined results: null or empty html gives an empty text; unclosed and crossed
elements end with their parent (of those whose content is never text, an unclosed
one ends before the next block-level element, too; menus and headers without an end
don't count where they hold the article or most of the page; only script, style,
textarea and title without an end reach to the page's end); an attribute whose quote is never
closed ends with its tag; a tag that the page's end cuts off is left out; repeated
rows are extracted alike; very long pages are handled whole, one page in memory at
a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.llm import html_layouts

#: Elements whose edges end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is text of their own, up to their own end tag.
WHOLE = frozenset("script style textarea title xmp".split())
#: Elements whose content is never an article's text, and those of them that a second one of their kind ends.
MUTED = frozenset("noscript template svg iframe object select button audio video canvas datalist".split())
SINGLE = frozenset("noscript iframe select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that the next block-level element ends, and those that the next of their kind ends, inside the elements that hold them.
SHORT = HEADINGS | {"p"}
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}
HOLDS = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt", "dd"), "table": ("td", "th", "tr"), "tr": ("td", "th")}
CHROME = frozenset("nav footer aside header form menu dialog fieldset head label legend search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status toolbar".split())
PARAGRAPHS = SHORT | frozenset("blockquote pre figcaption dd dt li td th caption summary".split())
#: Parts of class and id values that mark what surrounds an article; comments and other pages' articles even where an article element bears them.
HEADER = "header|masthead"
ASIDE = r"comments?|commentlist|replies|respond|disqus|ads?|advert\w*|adsense|related|recommend\w*|teasers?|promo\w*|sponsor\w*"
OTHER = r"banner|breadcrumbs?|cookies?|consent|gdpr|footer|footnav|menu|nav\w*|newsletter|notices?|alert|pager|pagination|popup|modal|share|sharing|sidebar|sidenav|side|rail|social|subscribe|subscription|signup|login|toolbar|widgets?|toc|skip"
_part = lambda words: re.compile(rf"(?:^|[-_])(?:{words})(?=$|[-_\d])")
HEADER_PART, ASIDE_PART, OTHER_PART = _part(HEADER), _part(ASIDE), _part(OTHER)
NEGATED = re.compile(r"(?:no|not|has|with|without|hide|show|is)[-_]|.*[-_](?:open|opened|closed|enabled|disabled|visible|hidden)$")
STORY = frozenset("article post entry story hentry article-body article-content article-text articlebody entry-content post-content post-body story-body story-content story-text".split())
#: Short phrases of what surrounds articles, and headings after which no article goes on.
PHRASES = re.compile(
    r"©|\bcopyright\b|all rights reserved|privacy policy|terms of (?:use|service)|\bcookies?\b|\bsubscribe\b|sign up|\bnewsletter\b|log ?in\b|sign in|\badvertisement\b|\bsponsored\b|share this|follow us|read more|leave a (?:reply|comment)"
    r"|alle rechte vorbehalten|datenschutz|\bimpressum\b|\banzeige\b|tous droits réservés|mentions légales|\bpublicité\b|todos los derechos reservados|\bpublicidad\b",
    re.I,
)
ENDING = re.compile(r"(?:\d+ )?(?:(?:reader )?comments?|replies|responses|kommentare|commentaires|comentarios)(?: ?\(\d+\))?:?|leave a (?:reply|comment)|related(?: (?:articles|posts|stories|links))?:?|more (?:stories|articles|from .{1,40})|you (?:may|might) also like:?|share this:?|add (?:a|your) comment", re.I)

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE = re.compile(r"=\s*[\"']")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
EMPTY = re.compile(r"(?:^|[\s\"'])/\s*$")  # a tag that ends itself; not a slash at the end of an unquoted value
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Scanner:
    """Finds strings in a page; a string's next place is remembered, so all searches together are linear."""

    def __init__(self, page: str):
        self.page, self.size, self.next = page, len(page), {}

    def find(self, what: str, start: int) -> int:
        at = self.next.get(what, -1)
        if at < start:
            at = self.page.find(what, start)
            at = self.next[what] = self.size if at < 0 else at
        return at

    def tag_end(self, at: int) -> int:
        """The ``>`` that ends the tag whose attributes start at ``at``; the page's size without one.

        Quotes count where they open an attribute's value.  One that isn't closed, or
        whose next quote opens the value of another tag, doesn't hide the ``>``.
        """
        page = self.page
        while True:
            end = self.find(">", at)
            opened = QUOTE.search(page, at, end)
            if opened is None:
                return end
            close = self.find(page[opened.end() - 1], opened.end())
            if close > end and (close == self.size or page[close + 1 : close + 2].strip(" \t\r\n\f/>") or page[opened.end() : close].rstrip().endswith("=")):
                return end
            at = close + 1

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """(kind, name or text, attributes): text, start and end tags in page order; comments and declarations are left out."""
        page, at = self.page, 0
        while at < self.size:
            tag = self.find("<", at)
            if tag > at:
                yield "text", page[at:tag], ""
            at, first = tag + 1, page[tag + 1 : tag + 2]
            if first == "!" and page.startswith("--", tag + 2):
                at = tag + 5 if page.startswith(">", tag + 4) else self.find("-->", tag + 4) + 3
            elif first and first in "!?":
                at = self.find(">", tag) + 1
            elif m := NAME.match(page, tag + 1 + (first == "/")):
                end, name = self.tag_end(m.end()), m[0].lower()
                if end == self.size:
                    return
                yield "end" if first == "/" else "start", name, page[m.end() : end]
                at = end + 1
                if first != "/" and name in WHOLE:
                    own = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                    at = self.find(">", own.end()) + 1 if own else self.size
            elif first == "/":
                at = self.find(">", tag) + 1
            elif tag < self.size:
                yield "text", "<", ""


@dataclass(slots=True)
class Node:
    name: str
    parent: int
    attributes: str
    holds: dict[str, int]  # where the nearest open elements are that the next of their kind ends
    closed: bool = False
    until: int = -1  # for a muted element: the item before which it ends if it isn't closed
    last: int = 0  # the last node inside
    words: int = 0
    title: bool = False  # holds an h1


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    tag: str  # the innermost block-level element
    chrome: bool  # inside menus, footers, forms and so on, by element or role
    hinted: bool  # inside an element whose class or id says so
    article: bool  # inside article or main
    above: int = 0  # the element around the innermost one
    share: float = 0.0  # how much of the page's other text is inside article or main
    held: int = 0  # words inside article or main, 100 at most
    boiler: bool = False
    ended: bool = False


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, int] | None], list[list[int]]]:
    """Nodes (parents first), items (node, text and link; null at a block's edge) and links (closed, first edge after its start)."""
    nodes, items, links = [Node("", 0, "", {})], [], []
    stack, opened, fresh = [0], Counter(), []
    link, depth = -1, 0

    def edge() -> None:
        if items and items[-1] is not None:
            items.append(None)
        if link >= 0 and links[link][1] < 0:
            links[link][1] = len(items)

    def pop(closed: str | None = None) -> None:
        nonlocal link
        node = nodes[stack.pop()]
        opened[node.name] -= 1
        node.closed = node.name == closed
        if link >= 0 and len(stack) < depth:
            link = -1

    for kind, name, attributes in Scanner(page).tokens():
        if kind == "text":
            items.append((stack[-1], name, link))
        elif name == "br":
            items.append((stack[-1], "\n", link))
        elif kind == "end":
            if name == "a" and link >= 0:
                links[link][0], link = 1, -1
            if name in BLOCK:
                edge()
            if opened[name] > 0:
                while nodes[stack[-1]].name != name:
                    pop()
                pop(name)
        elif name == "a":
            if "href" in attributes.lower() and not EMPTY.search(attributes):
                link, depth = len(links), len(stack)
                links.append([0, -1])
        elif name in BLOCK or name in MUTED:
            if name in BLOCK:
                edge()
                for k in fresh:
                    nodes[k].until = len(items)
                fresh.clear()
                while nodes[stack[-1]].name in SHORT:
                    pop()
            at = max((nodes[stack[-1]].holds.get(x, -1) for x in ENDS.get(name, ())), default=-1)
            if name in SINGLE and opened[name] > 0:
                while nodes[stack[-1]].name != name:
                    pop()
                pop()
            while 0 <= at < len(stack):
                pop()
            if name in MUTED and EMPTY.search(attributes):
                continue
            holds = nodes[stack[-1]].holds
            if name in HOLDS:
                holds = {k: v for k, v in holds.items() if k not in HOLDS[name]}
            if name in ENDS:
                holds = {**holds, name: len(stack)}
            nodes.append(Node(name, stack[-1], attributes, holds))
            stack.append(len(nodes) - 1)
            opened[name] += 1
            if name in MUTED:
                fresh.append(len(nodes) - 1)
        elif name == "hr":
            edge()
    return nodes, items, links


def told(attributes: str) -> dict[str, str]:
    """The attributes that say what an element is for."""
    low = attributes.lower()
    if not any(x in low for x in ("class", "id", "role", "itemprop", "hidden", "style")):
        return {}
    return {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page in page order."""
    nodes, items, links = parse(page or "")
    for k, x in enumerate(items):
        if x is not None:
            nodes[x[0]].words += len(x[1].split())
    for k in range(len(nodes) - 1, 0, -1):
        node, above = nodes[k], nodes[nodes[k].parent]
        node.last = max(node.last, k)
        above.last = max(above.last, node.last)
        above.words += node.words
        above.title |= node.title or node.name == "h1"
    said = [told(n.attributes) for n in nodes]
    role = [x.get("role", "").strip().lower() for x in said]
    bears = [n.name in ("article", "main") or role[k] in ("main", "article") for k, n in enumerate(nodes)]
    largest = max((k for k, x in enumerate(bears) if x), key=lambda k: (nodes[k].words, -k), default=-1)
    chrome, hinted, article, muted = [False], [False], [False], [-1]
    for k in range(1, len(nodes)):
        n, p = nodes[k], nodes[k].parent
        wraps = k <= largest <= n.last
        names = [CAMEL.sub("-", x).lower() for v in (said[k].get("class", ""), said[k].get("id", "")) for x in v.split()]
        story = bears[k] or said[k].get("itemprop", "").lower() == "articlebody" or any(x in STORY for x in names)
        names = [x for x in names if not NEGATED.match(x)]
        own = n.name in CHROME and not (n.name == "header" and article[p]) and not (n.name in ("form", "fieldset") and (wraps or n.title)) or role[k] in ROLES and not wraps
        # a menu or header without an end isn't what holds the article, or most of the page
        own &= n.closed or not (wraps or n.name in ("nav", "header", "menu") and 2 * n.words > nodes[0].words)
        own |= "hidden" in said[k] or said[k].get("aria-hidden", "").strip().lower() == "true" and not wraps or re.search(r"display\s*:\s*none", said[k].get("style", ""), re.I) is not None
        hint = any(ASIDE_PART.search(x) for x in names) and not (n.name not in ("article", "section") and wraps and nodes[largest].name == "main")
        if not bears[k] and not wraps:
            hint |= any(OTHER_PART.search(x) for x in names) or not article[p] and any(HEADER_PART.search(x) for x in names)
        if n.name in ("html", "body", "main"):
            hint = False
        chrome.append(chrome[p] or own)
        hinted.append(hinted[p] or hint)
        article.append(article[p] or story)
        until = -1 if n.name not in MUTED else n.until if not n.closed and n.until >= 0 else len(items)
        muted.append(max(until, muted[p]))

    out: list[Block] = []
    parts: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            n = text.count(" ") + 1
            short = n <= 25
            out.append(Block(text, n, min(linked, n), nodes[at].name, chrome[at], hinted[at], article[at], nodes[at].parent, boiler=short and PHRASES.search(text) is not None))
        parts.clear()
        linked = 0

    for k, x in enumerate([*items, None]):
        if x is None:
            flush()
            continue
        node, text, link = x
        if k < muted[node]:
            continue
        text = html.unescape(text)
        parts.append(text)
        at = node
        if link >= 0 and (links[link][0] or k < links[link][1] or links[link][1] < 0):
            linked += len(text.split())
    clean = [b for b in out if not b.chrome and not b.hinted]
    inside = sum(b.words for b in clean if b.article)
    share = inside / max(1, sum(b.words for b in clean))
    ended: set[bool] = set()
    told_in: set[int] = set()  # elements whose paragraphs are an article's
    for b in out:
        b.share, b.held, b.ended = share, min(inside, 100), b.article in ended
        if b.words <= 6 and (b.tag in HEADINGS or b.tag not in PARAGRAPHS) and ENDING.fullmatch(b.text):
            # beside the article's own paragraphs it is the heading of one of its sections
            if not (b.article and b.tag in HEADINGS and b.above in told_in):
                b.ended = True
                ended |= {b.article, False}
        elif b.article and b.tag == "p" and not b.chrome and not b.hinted and not b.ended:
            told_in.add(b.above)
    return out


FEATURES = ["words", "density", "prev_words", "prev_density", "next_words", "next_density", "chrome", "hinted", "article", "share", "held", "heading", "paragraph", "item", "boiler", "ended"]


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """A row of FEATURES for each block."""
    own = [(min(b.words, 100), b.linked / b.words) for b in found]
    none = (0, 0.0)
    rows = []
    for k, b in enumerate(found):
        before, after = own[k - 1] if k else none, own[k + 1] if k + 1 < len(own) else none
        item = b.tag in ("li", "td", "th", "dt", "dd")
        rows.append((*own[k], *before, *after, *map(float, (b.chrome, b.hinted, b.article, b.share, b.held, b.tag in HEADINGS, b.tag in PARAGRAPHS, item, b.boiler, b.ended))))
    return rows


def labelled(layouts: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: FEATURES of every block of the layouts, and whether it belongs to the article."""
    x, y = [], []
    for layout in html_layouts.LAYOUTS if layouts is None else layouts:
        for fill in range(html_layouts.FILLS):
            found = blocks(html_layouts.filled(layout, fill))
            x += features(found)
            y += [html_layouts.MARK in b.text for b in found]
    return np.array(x, np.float64), np.array(y, np.float64)


def grow(x: np.ndarray, y: np.ndarray, least: int = 4, gain: float = 1.5) -> tuple | float:
    """A decision tree: (feature, cut, not above, above), or the share of label 1 in a leaf.

    Leaves have at least ``least`` rows; a split lowers the Gini impurity of its
    rows (summed over them) by at least ``gain``.
    """
    impure = lambda n, ones: 2 * ones * (n - ones) / np.maximum(n, 1)
    n, share = len(y), float(y.mean())
    best = (impure(n, y.sum()) - gain, -1, 0.0)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, below, ones = x[order, k], np.arange(1, n), np.cumsum(y[order])[:-1]
        total = impure(below, ones) + impure(n - below, y.sum() - ones)
        total[(v[1:] == v[:-1]) | (below < least) | (n - below < least)] = np.inf
        if n > 1 and total.min() < best[0] - 1e-12:
            at = int(total.argmin())
            best = (float(total[at]), k, float(v[at] + v[at + 1]) / 2)
    _, k, at = best
    if k < 0:
        return share
    low = x[:, k] <= at
    return (k, at, grow(x[low], y[low], least, gain), grow(x[~low], y[~low], least, gain))


def says(tree: tuple | float, x: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        k, at, low, high = tree
        tree = high if x[k] > at else low
    return tree >= 0.5


def main_text(page: str | None, tree: tuple | float) -> str:
    found = blocks(page)
    return " ".join(b.text for b, x in zip(found, features(found), strict=True) if says(tree, x))


def extract(pages: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text (the main text) and n_chars of every page."""
    tree = grow(*labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(t.as_py(), tree) for t in b.column("_html")]
            own = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*keep, "text", "n_chars"])

    df = pages.select(*keep, F.coalesce(F.col(source), F.lit("")).alias("_html"))
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes if n != "_html")
    return df.mapInArrow(run, f"{schema}, text string, n_chars long")
