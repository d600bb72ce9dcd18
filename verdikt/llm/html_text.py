"""Main text of web pages from flat text blocks and a decision tree.

A page is cut at block-level tags into flat blocks of text.  Each block is
described by its own and its neighbours' word counts and link densities and by
the element it lies in; a decision tree, grown from the small labelled table
below, tells article text from menus, notices, adverts and the rest.

Scripts, styles, comments and other invisible elements are no text.  Tags may be
unclosed, crossed or missing; an element ends where its tag or that of an outer
element ends, a paragraph or list item where the next one starts.

Defined results: a null or empty page has the empty text; repeated pages give
rows each; character references are decoded, white space inside a block becomes
one space, blocks join by one space in page order, nothing is cut.  A page of any
length takes one pass; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdikt.llm.common import map_batches, texts_of

#: How what is no tag begins and ends; the first two end with the page at the latest.
OTHERS = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"))
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: Attributes up to the end of a tag; quoted values may hold its end.
ATTRIBUTES = re.compile(r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+""")
HINT = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Attribute names and values, in any quotes or none.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
DISPLAY_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.I)
#: Elements by what they do to text.
INVISIBLE = frozenset("script style noscript template head title iframe object svg canvas math select textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDES = frozenset("nav header footer aside form menu dialog button fieldset address".split())
MAIN = frozenset("article main".split())
#: Elements whose content is passed over up to their end tag, whatever it looks like.
SKIPPED = {tag: re.compile(rf"</{tag}(?![A-Za-z0-9:-])[^>]*>?", re.I) for tag in "script style noscript template textarea title svg".split()}
#: Words in class, id or role that name what is not the article ...
NOTICES = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|"
    r"subscri\w*|signup|login|share|sharing|social|related|recommend\w*|sidebar|widget|menu|nav\w*|breadcrumbs?|pag(?:er|ination)|"
    r"footer|header|masthead|copyright|legal|tags?|comments?|disqus|respond|replies|reply|search|toolbar|skip"
)
#: ... that may stand beside them in a name ...
BESIDE = frozenset(
    "area bar block blocks bottom box button buttons card container form global group holder inner item items left link links list "
    "main outer panel primary right row secondary section site slot strip top unit wrap wrapper zone".split()
)
#: ... and words that name the article.
CONTENT = re.compile(r"article\w*|content|entry|post|story|body\w*|text|main")


def class_evidence(names: str) -> tuple[int, int]:
    """(notices, contents): how many of the names say notice with all their words, and how many say content with one."""
    notices = contents = 0
    for name in names.split():
        words = [w for w in re.split(r"[-_:]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        named = [bool(NOTICES.fullmatch(w)) for w in words]
        if any(named):
            notices += all(n or w in BESIDE or w.isdigit() for n, w in zip(named, words, strict=True))
        else:
            contents += any(CONTENT.fullmatch(w) for w in words)
    return notices, contents


def is_hidden(attributes: str) -> bool:
    """Whether a tag's attributes hide it: ``hidden``, ``aria-hidden=true`` or a style of display:none.

    Of repeated attributes the first counts.
    """
    if not attributes.strip():
        return False
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), unescape(value.strip("\"'")).strip())
    return (
        "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(DISPLAY_NONE.search(found.get("style", "")))
    )


@dataclass
class Block:
    text: str
    words: int
    linked: int
    tag: str
    aside: bool
    notice: bool
    main: bool
    heading: bool
    item: bool


@dataclass
class _Mark:
    """An element that sets its text apart, unless it turns out to hold the article itself."""

    outer: _Mark | None
    notice: bool
    form: bool
    holds_main: bool = False
    holds_title: bool = False
    #: Whether this or an outer mark makes a notice, an aside, an aside that is no form.
    says: tuple[bool, bool, bool] = (False, False, False)

    def settle(self) -> None:
        void = self.holds_main or (self.holds_title and (self.notice or self.form))
        mine = (self.notice and not void, not self.notice and not void, not self.notice and not self.form and not void)
        outer = self.outer.says if self.outer else (False, False, False)
        self.says = tuple(a or b for a, b in zip(mine, outer, strict=True))


@dataclass
class _Open:
    tag: str
    mark: _Mark | None
    main: bool
    hidden: bool


@dataclass
class _Page:
    blocks: list[tuple[Block, _Mark | None]] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", None, False, False)])
    marks: list[_Mark] = field(default_factory=list)
    names: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0

    def add(self, text: str) -> None:
        if text and not self.stack[-1].hidden:
            text = unescape(text)
            self.parts.append(text)
            if self.links:
                self.linked += len(text.split())

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            tags = [o.tag for o in self.stack[-4:]]
            block = Block(
                text, len(text.split()), self.linked, top.tag, False, False, top.main,
                any(re.fullmatch("h[1-6]", t) for t in tags), any(t in ("li", "dt", "dd") for t in tags),
            )
            self.blocks.append((block, top.mark))
        self.parts, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.stack[-1].tag == tag:
            self.pop(len(self.stack) - 1)  # a paragraph or item ends before the next one in the same parent
        top = self.stack[-1]
        hints = " ".join(h.strip("\"'") for h in HINT.findall(attributes)) if attributes.strip() else ""
        notices, contents = class_evidence(hints) if hints else (0, 0)
        notice = notices > contents and not (tag in MAIN or tag in ("body", "html"))
        main = tag in MAIN or (contents > 0 and not notice)
        inner_header = tag == "header" and top.main  # the heading of the article itself
        mark = top.mark
        if tag in MAIN:
            while mark and not mark.holds_main:
                mark.holds_main, mark = True, mark.outer
            mark = None
        elif tag == "h1":
            while mark and not mark.holds_title:
                mark.holds_title, mark = True, mark.outer
            mark = top.mark
        if notice or (tag in ASIDES and not inner_header):
            mark = _Mark(mark, notice, tag == "form")
            self.marks.append(mark)
        self.stack.append(_Open(tag, mark, top.main or main, top.hidden or tag in INVISIBLE or is_hidden(attributes)))
        self.names[tag] += 1

    def pop(self, start: int) -> None:
        for gone in self.stack[start:]:
            self.names[gone.tag] -= 1
        del self.stack[start:]

    def close(self, tag: str) -> None:
        if not self.names[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                return self.pop(i)
            if tag in ("p", "b", "i", "li") and self.stack[i].tag in ("div", "article", "section", "body", "ul", "table"):
                return  # a stray end tag does not close what is outside

    def judged(self) -> list[Block]:
        """The blocks with their marks; marks that all blocks carry say nothing."""
        for mark in self.marks:  # outer ones first
            mark.settle()
        said = [mark.says if mark else (False, False, False) for _, mark in self.blocks]
        everywhere = all(notice or aside for notice, aside, _ in said)
        for (block, _), (notice, aside, no_form) in zip(self.blocks, said, strict=True):
            block.notice, block.aside = (False, no_form) if everywhere else (notice, aside)
        return [block for block, _ in self.blocks]


def tag_end(html: str, start: int) -> int:
    """Where the attributes from ``start`` end: at a > outside quotes, else at the next one; -1 without any."""
    end = ATTRIBUTES.match(html, start).end()
    return end if html.startswith(">", end) else html.find(">", start)


def blocks_of(html: str) -> list[Block]:
    """The flat text blocks of a page, in page order; one pass from left to right."""
    page = _Page()
    at = spot = 0  # text from ``at`` is not yet added; the next tag is sought from ``spot``
    while (spot := html.find("<", spot)) >= 0:
        if other := next((o for o in OTHERS if html.startswith(o[0], spot)), None):
            end = html.find(other[1], spot + len(other[0]))
            if end < 0 and other[1] == ">":
                break
            page.add(html[at:spot])
            end = end if end >= 0 else len(html)
            if other[1] == "]]>":
                page.add(html[spot + len(other[0]) : end].replace("&", "&amp;"))
            at = spot = min(end + len(other[1]), len(html))
            continue
        found = TAG.match(html, spot)
        if not found:
            spot += 1
            continue
        end = tag_end(html, found.end())
        if end < 0:
            break
        page.add(html[at:spot])
        tag, closing, attributes = found[2].lower(), found[1] == "/", html[found.end() : end]
        at = spot = end + 1
        if tag in SKIPPED and not closing:
            if not attributes.endswith("/"):
                close = SKIPPED[tag].search(html, at)
                at = spot = close.end() if close else len(html)
        elif tag == "br":
            page.parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                page.links = 0 if closing else 1
        else:
            page.flush()
            page.links = 0
            if closing:
                page.close(tag)
            elif tag not in VOID and not attributes.endswith("/"):
                page.open(tag, attributes)
    comment = html.find("<!--", max(at, spot)) if spot >= 0 else -1
    page.add(html[at:] if comment < 0 else html[at:comment])
    page.flush()
    return page.judged()


#: Of a block and its neighbours, in this order.
FEATURES = (
    "words", "link_density", "words_before", "density_before", "words_after", "density_after",
    "aside", "notice", "main", "page_has_main", "heading", "item", "ends_sentence",
)


def described(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    has_main = float(any(b.main for b in blocks))
    words = [min(b.words, 200) for b in blocks]
    density = [b.linked / b.words for b in blocks]
    rows = []
    for i, b in enumerate(blocks):
        rows.append(
            (
                words[i], density[i],
                words[i - 1] if i else 0, density[i - 1] if i else 0.0,
                words[i + 1] if i + 1 < len(blocks) else 0, density[i + 1] if i + 1 < len(blocks) else 0.0,
                b.aside, b.notice, b.main, has_main, b.heading, b.item, b.text[-1] in ".!?…:;\"”»",
            )
        )
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


#: The labelled table: pages whose article blocks carry the mark x-keep on their tag.
LABELLED = (
    """<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>World news</a></li></ul></nav><div class="ad">Buy two lamps and
    pay for one of them today.</div><article><h1 x-keep>The river rose again</h1><p x-keep>After three days of rain the river
    rose above the old mark, and the lower town was closed to all traffic.</p><p x-keep>Nobody was hurt.</p><p x-keep>See the
    <a href=/m>map</a>.</p></article><footer>&copy; the paper &middot; All rights are reserved by it.</footer>""",
    """<div id=header><a href=/>Logo</a></div><div class="cookie-notice">We use cookies to make this page better for you. Please
    accept them all.</div><main><h2 x-keep>How to bake</h2><p x-keep>Mix flour and water.</p><ul><li x-keep>Let it rest for an
    hour in a warm place.</li><li x-keep>Bake it.</li></ul><p x-keep>Serve it warm with butter, as everybody in the valley has
    done for two hundred years or more.</p><div class="share"><a href=#>Share this</a></div><div class="comments"><p>I tried it
    and it was very good, thank you for writing this down for us.</p><p>Nice!</p></div></main><aside><p>Most read this week by
    all of our readers in every country.</p></aside>""",
    """<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><div x-keep>The committee met on Monday to talk
    about the bridge, which has been closed since the storm of last year, and about the money for it.</div><div x-keep>It will
    meet again in the autumn, when the report of the engineers has been read by all of its members.</div><div x-keep>A date
    was not given.</div></div><div><a href=4>Next story</a></div><div><a href=5>Imprint</a> <a href=6>Contact</a></div>
    <form><label>Your name</label><input><p>Please leave your address and we will send you the letter every week.</p></form>""",
    """<body><table><tr><td><a href=1>Shop</a></td><td><a href=2>Cart</a></td></tr></table><h1 x-keep>A walk in the hills</h1>
    <p x-keep>We left early and came to the top before noon, where the wind was cold and the view was wide and clear.</p>
    <p x-keep>It was quiet.</p><p x-keep>On the way down we met a shepherd who told us of the winter when the wolves came to the
    village and slept in the church.</p><ul><li><a href=7>Older walks</a></li><li><a href=8>Newer walks</a></li></ul>
    <div>Copyright 2019</div></body>""",
    """<header><p>The daily paper of the whole valley since the year of the great flood.</p></header><nav><a href=1>News</a></nav>
    <article><header><h1 x-keep>Small words</h1></header><p x-keep>Yes.</p><p x-keep>A longer paragraph follows the short one and
    says what happened in the town on that day and why.</p><div class="advertisement">Only today: all shoes at half the price in
    every shop of ours.</div><p x-keep>No.</p><aside>Read also what we wrote about this last year in our other paper.</aside>
    <section id="comments"><h3>Comments</h3><p>You are wrong about this, as you have been about everything else before.</p>
    </section></article><footer><p>Written, printed and sent by the paper; call us when you want to know more.</p></footer>""",
    """<article><p x-keep>*** one &amp; two ### three $$$ four</p><p x-keep>| a | b | c | d |</p><p x-keep>HELLO!! HELLO!!</p>
    <p x-keep><a href=1>A linked sentence is a part of it.</a></p></article><div class="sidebar"><p>Ten things you did not know
    about the moon and its many faces.</p><ul><li>First of them</li></ul></div><footer>Made with care. The text above belongs to
    those who wrote it down.</footer>""",
    """<header><p>This is the paper of the valley and of the hills around it, printed every day but Sunday since the year of the
    flood, and read in every house from the mill to the pass by young and old.</p></header><div class="ad">Our summer sale has
    begun, and all coats, boots, hats and gloves in all of our shops are sold at half of their price until the end of the month
    or while there are any left.</div><article><h1 x-keep>A new mill</h1><p x-keep>Short.</p><p x-keep>The old mill has burnt
    down in the night.</p></article><aside><p>In our last number we wrote about the fire in the harbour, the men who put it out,
    and what the town means to do so that it does not come again next year.</p></aside><footer>Whoever copies the texts of this
    paper without asking breaks the law of the land, and will be asked to pay for it, whether they have sold them or given them
    away.</footer>""",
    """<div class="banner">The bridge stays closed for all carts until the end of the month, and whoever wants to cross the river
    has to use the ferry at the mill instead.</div><div x-keep>Long ago a miller had three sons, a mill, a donkey and a cat, and
    when he died they shared what he had left to them among themselves.</div><div x-keep>The youngest got the cat.</div>
    <div x-keep>He was sad.</div><footer>All of the stories on these pages were told to us by people of the valley, written down
    by our readers, and may be told again by all who like them.</footer><div id="comments"><p>My grandmother told me this one
    when I was small, but in hers the cat could not talk and had no boots, and there was no king.</p></div>""",
    """<nav><p>From here you can go to the news of the day, to the weather of the week, to the letters of our readers, or back to
    the page you came from.</p></nav><div x-keep>Words.</div><div x-keep>Two more words here.</div><form><p>Write to us what you
    think about this page, what you would like to read more of, and what we should rather leave out of it.</p></form>
    <aside>Other stories of the same kind are kept in the old book, which you may read in our house on any day of the week except
    on Sunday.</aside>""",
)


@dataclass
class Tree:
    """A binary decision tree; leaves have no feature."""

    keep: bool
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def says(self, row: np.ndarray) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.keep


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 2) -> Tree:
    """A tree by least Gini impurity; equal splits go to the first feature and the lowest cut."""
    leaf = Tree(bool(2 * labels.sum() >= len(labels)))
    if depth == 0 or len(labels) < 2 * least or labels.min() == labels.max():
        return leaf
    best = (len(labels) * 2 * labels.mean() * (1 - labels.mean()) - 1e-9, -1, 0.0)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            parts = [labels[low], labels[~low]]
            if min(map(len, parts)) < least:
                continue
            impure = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in parts)
            if impure < best[0] - 1e-12:
                best = (impure, f, float(cut))
    if best[1] < 0:
        return leaf
    low = rows[:, best[1]] <= best[2]
    return Tree(
        leaf.keep, best[1], best[2],
        grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least),
    )


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of all blocks of the labelled table."""
    rows, labels = [], []
    for page in LABELLED:
        marked = re.sub(r"<(\w+) x-keep>", r"<\1>KEEP ", page)
        plain = blocks_of(re.sub(r" x-keep>", ">", page))
        rows.append(described(plain))
        labels += [b.text.startswith("KEEP ") for b in blocks_of(marked)]
    return np.concatenate(rows), np.array(labels, dtype=float)


@lru_cache
def article_tree() -> Tree:
    return grow(*labelled_rows())


def main_text(html: str) -> str:
    """The article of one page."""
    blocks = blocks_of(html)
    tree = article_tree()
    return " ".join(b.text for b, row in zip(blocks, described(blocks), strict=True) if tree.says(row))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; pages are never shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(html) for html in texts_of(batch["html"])]
        return pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    kinds = dict(pages.dtypes)
    return map_batches(
        pages, ["page_id", "url", "html"], run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
