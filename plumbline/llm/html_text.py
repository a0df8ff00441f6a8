"""Main text of web pages: streamed parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams start, end and data events, from which the page's lines are cut: a line is the
text between two block boundaries, with the number of tags met in it and the container that holds it. A line's ratio
is its text outside links over its tags; lines inside elements that are page furniture by tag, role or name (menus,
sidebars, adverts, forms, comments ...) have none. The ratios are smoothed by a Gaussian, and lines above a threshold
set from their spread form clusters. The clusters choose the region: the ``article`` or ``main`` around the innermost
container that holds most of their text, and the whole page where there is none. Every line of the region is returned,
short ones too, but furniture, so that the ratios decide where the article is and never drop a paragraph of it. Where
the region is the whole page, link lists (containers of three links or more that hold 80 % of their text) go as menus;
in an ``article`` or ``main`` they may be its references, and only tag, role or name tell a menu. There the clusters also
decide on blocks: a plain block (``div``, ``section`` ...) beside the innermost container goes if no line of it is in a
cluster by its own ratio, and it stands wholly before the first heading or such line or after the last one ("Skip to
content", "Share this"), unless it holds a sentence, a list, a table, a quotation or a figure, which may end an article.

A name is a word list's guess, so it needs company: a class or id makes furniture by itself only if all of its words
are names of furniture or of layout ("cookie-banner", "related-posts-list"). Where a word says something else
("social-history", "share-price", "story-related-art"), the figures of the block decide: it is furniture if half of its
text stands in links; so they do for a "widget" within an article, and for a fieldset whether there is something to
fill in. Furniture given by a form or a name is weighed: where most of a page lies in it, and no article or main stands outside,
it is a wrapper ("no-comments", the one form of a page) and not furniture. Comments may be longer than what they comment
on, so that a wrapper by their names must hold nearly all of the page. A ``main`` inside furniture by form or name, and
an ``article`` inside a form, are content. Menus, asides, footers, roles, labels and hidden elements are final.

Nulls: a null page has an empty text. Broken markup is read as the parser reads it; unclosed elements end with their
parents, unread ones (an open ``svg`` or ``button``) too. Time is linear in the page, however deep it is nested. Ties:
of containers that hold equally much, the innermost. Repeated rows are extracted one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import extend, table

#: Width of the smoothing in lines, and the threshold as a multiple of the ratios' standard deviation.
SIGMA, RADIUS, THRESHOLD = 1.0, 2, 0.5
#: The region is sought from the innermost container with this share of the clustered text upwards.
REGION_SHARE = 0.8

#: Elements that hold blocks, elements that end a line but hold none, and elements that are furniture.
CONTAINERS = {"body", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "blockquote", "figure", "fieldset", "details", "dialog", "menu", "center", "address", "hgroup", "search"}
LINES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "figcaption", "caption", "summary", "legend", "hr", "option", "html"}
FURNITURE = {"nav", "aside", "footer", "dialog", "menu", "search"}
#: Blocks that say nothing of what they hold, those that an article is made of, and the headings of a page.
PLAIN, PARTS, HEADS = {"div", "section", "center", "address", "header"}, {"ul", "ol", "dl", "table", "blockquote", "figure", "details"}, {"h1", "h2"}
#: Elements that are filled in; a fieldset that holds one is a form, whether or not one stands around it.
FIELDS = {"input", "select", "textarea", "button"}
UNREAD = {"head", "title", "script", "style", "noscript", "template", "iframe", "object", "svg", "select", "button", "textarea", "canvas", "audio", "video"}
#: Elements that may stand in a head; any other start tag ends it.
IN_HEAD = {"html", "head", "title", "meta", "link", "base", "basefont", "bgsound", "script", "style", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar aside widget widgets menu nav navbar navigation topnav breadcrumb breadcrumbs masthead footer header pagination pager share sharing social related recommended recommendations trending login signup search searchbox searchform toolbar copyright disclaimer adsbygoogle advertorial rail".split())
ARTICLE_NAMES = {"article", "post", "entry", "story"}
#: Words of layout and of what furniture is made of: beside a name of furniture they say nothing else.
LAYOUT = set("a all area article articles bar block body bottom box btn button buttons center col column columns container content feed fixed float form global grid group heading holder icon icons inline inner input item items js label left line link links list main message mobile module more most news outer page panel part post posts primary region right row secondary section site slot sticky story stories strip text the title tool tools top unit up user wrap wrapper zone".split())
#: The share of its text in links from which a block of a mixed name is furniture.
LINKED = 0.5
#: Names that also tell of a page's layout ("has-sidebar").
LAYOUT_NAMES = {"sidebar", "aside", "menu", "nav", "navbar", "header", "footer", "widget", "widgets", "social", "search", "overlay", "notices"}
LABELS = {"navigation", "menu", "breadcrumb", "breadcrumbs", "advertisement", "sidebar", "related"}
COMMENT_NAMES = set("comment comments commentlist respond replies reply disqus discussion".split())
#: Words that tell of comments together only ("reader-responses"; "emergency-response" is none).
READERS, ANSWERS = {"reader", "readers", "user", "users", "visitor", "visitors"}, {"responses", "reactions", "feedback", "opinions"}
#: Names of boxes that may hold anything: in an article only the figures of the block make them furniture.
BOXES = {"widget", "widgets"}
#: Shares of a page's text from which furniture by form, by name and by the names of comments is a wrapper.
WRAPPER = {"form": 0.5, "name": 0.5, "comments": 0.9}
#: Words by which an article or page tells of its comments ("comments-open").
STATES = {"no", "open", "closed", "enabled", "disabled", "without"}
_SPLIT = re.compile(r"[^a-z0-9]+")
_SENTENCE = re.compile(r"""[.!?…:。！？।؟][\"'”’»)\]]*\Z""")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def name_words(name: str) -> list[str]:
    """The words of a class or id, in small letters: "siteNav", "site-nav" and "site_nav" have the same. Two that make a
    name of furniture together count as it ("side-bar")."""
    words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
    for k in range(len(words) - 1):
        if words[k] + words[k + 1] in NAMES:
            words[k : k + 2] = [words[k] + words[k + 1], ""]
    return [w for w in words if w]


class Lines(HTMLParser):
    """Cuts a page into lines while it is parsed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents: list[int] = [-1]  # container number -> its parent
        self.plain: list[list] = [["#page", 0, 0, 0]]  # container number -> tag, text, text in links, links (of its own, until ``total``)
        self.stack: list[tuple[str, int, int, bool]] = [("#page", 0, 0, False)]  # tag, container, furniture (0 no, 1 by name, 2 for good), in an article or main
        self.open: Counter[str] = Counter()  # elements on the stack
        self.mixed: set[int] = set()  # containers of a mixed name, which is furniture if their figures agree
        self.fields: set[int] = set()  # containers with something to fill in
        self.named: dict[int, int] = {}  # container -> the outermost one whose name makes it furniture
        self.weighed: dict[int, str] = {}  # container -> form, name or comments, which make it furniture if it is no wrapper
        self.final: set[int] = set()  # containers that are furniture for good
        self.out: list[tuple[str, int, int, int, int]] = []  # text, in links, tags, container, furniture
        self.heads: list[int] = []  # numbers of the lines that are headings
        self.text: list[str] = []
        self.unread: list[str] = []
        self.within: Counter[str] = Counter()  # containers and lines that opened in what is not read
        self.linked = self.tags = self.links = self.unlisted = 0

    def line(self) -> None:
        """Ends the line."""
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                _, container, furniture, _ = self.stack[-1]
                self.out.append((text, self.linked, self.tags, container, furniture))
                box = self.plain[container]
                box[1] += len(text)
                box[2] += min(self.linked, len(text))
                box[3] += self.links
        self.text, self.linked, self.tags, self.links = [], 0, 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in FIELDS and not self.unread:
            self.fields.add(self.stack[-1][1])
        if self.unread:
            if tag in UNREAD and tag not in VOID and (self.unread != ["head"] or tag in IN_HEAD):
                self.unread.append(tag)
            elif tag == "body" and self.unread[0] == "head" or self.unread == ["head"] and tag not in IN_HEAD:
                self.unread = []
            else:
                if tag in CONTAINERS or tag in LINES:
                    self.within[tag] += 1
                return
        if tag in UNREAD:
            if not self.unread:
                self.unread, self.within = [tag], Counter()
            return
        if tag in CONTAINERS:
            self.line()
            kind, why = self.kind(tag, attrs)
            above = self.stack[-1][1]
            self.parents.append(above)
            self.plain.append([tag, 0, 0, 0])
            if kind == 1:
                self.named[len(self.parents) - 1] = self.named.get(above, len(self.parents) - 1)
            self.note(kind, why)
            self.push(tag, kind)
        elif tag in LINES:
            self.line()
            if tag in HEADS:
                self.heads.append(len(self.out))
            kind, why = self.kind(tag, attrs) if attrs and tag != "html" else (0, None)
            if kind > self.stack[-1][2] or why:  # a paragraph that is itself furniture
                self.parents.append(self.stack[-1][1])
                self.plain.append([tag, 0, 0, 0])
                kind = self.stack[-1][2] if why else 2
                self.note(kind, why)
                self.push(tag, kind)
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.unlisted += 1
            self.links += 1
        self.tags += 1

    def push(self, tag: str, kind: int) -> None:
        self.stack.append((tag, len(self.parents) - 1, kind, self.stack[-1][3] or tag in ("article", "main")))
        self.open[tag] += 1

    def total(self) -> None:
        """Gives every container the figures of those in it, and settles which mixed names are furniture."""
        for c in range(len(self.plain) - 1, 0, -1):  # parents come first
            box, above = self.plain[c], self.plain[self.parents[c]]
            for k in (1, 2, 3):
                above[k] += box[k]
            if c in self.fields:
                self.fields.add(self.parents[c])
                if box[0] in ("fieldset", "dialog"):
                    self.weighed.setdefault(c, "form")
        for c in self.mixed:
            _, text, linked, links = self.plain[c]
            if links and linked >= LINKED * text:
                self.weighed[c] = "name"

    def note(self, kind: int, why: str | None) -> None:
        """Keeps what was found of the newest container."""
        if kind > 1:
            self.final.add(len(self.parents) - 1)
        elif why == "mixed":
            self.mixed.add(len(self.parents) - 1)
        elif why:
            self.weighed[len(self.parents) - 1] = why

    def kind(self, tag, attrs) -> tuple[int, str | None]:
        """Whether an element that starts here is furniture, and by what it is furniture to be weighed."""
        above = self.stack[-1][2]
        if above > 1:
            return 2, None
        why = "form" if tag == "form" else None
        if tag in ("article", "main"):
            above = 0
        inside = self.stack[-1][3]
        shown = tag == "dialog" and inside and any(name == "open" for name, _ in attrs)
        if tag in FURNITURE and not shown or tag == "header" and not inside:
            return 2, None
        for name, value in attrs:
            raw, value = value or "", (value or "").lower()
            if name in ("class", "id"):
                parts = [name_words(one) for one in raw.split()]
                every = {w for words in parts for w in words}
                if (every & COMMENT_NAMES or any(READERS & set(w) and ANSWERS & set(w) for w in parts)) and not (every & STATES and tag in ("body", "article", "main")):
                    why = "comments"
                elif tag not in ("body", "article", "main"):
                    for words in map(set, parts):
                        named = words & NAMES
                        if inside or every & ARTICLE_NAMES:  # an article's own header
                            named -= {"header"}
                        if named and (inside and named <= BOXES or not all(w in NAMES or w in LAYOUT or not w.isalpha() for w in words)):
                            why = why or "mixed"
                        elif named - LAYOUT_NAMES:
                            why = "name" if why in (None, "mixed") else why
                        elif named:
                            above = max(above, 1)
            elif name == "aria-label" and set(_SPLIT.split(value)) & (COMMENT_NAMES | LABELS):
                return 2, None
            elif name == "role" and value in ROLES - {"form"} or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                return 2, None
            elif name == "role" and value == "form":
                why = why or "form"
        return above, why

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in UNREAD:
            if not self.unread and tag not in UNREAD:
                self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.unread:
            if self.unread[-1] == tag:
                self.unread.pop()
                return
            if tag in UNREAD:
                if tag in self.unread:
                    del self.unread[len(self.unread) - 1 - self.unread[::-1].index(tag) :]
                return
            if self.within[tag]:
                self.within[tag] -= 1
                return
            if not self.open[tag]:
                return
            self.unread = []  # the end of an element around the unread one, which ends with it
        if tag == "a":
            self.unlisted = max(0, self.unlisted - 1)
        elif tag in CONTAINERS or tag in LINES:
            self.line()
            for k in range(len(self.stack) - 1, 0, -1) if self.open[tag] else ():
                if self.stack[k][0] == tag:
                    self.open.subtract(s[0] for s in self.stack[k:])
                    del self.stack[k:]
                    self.unlisted = 0
                    break
                if tag in LINES and self.stack[k][0] in CONTAINERS:
                    break
        self.tags += 1

    def handle_data(self, data):
        if self.unread == ["head"] and data.strip():
            self.unread = []
        if not self.unread:
            self.text.append(data)
            if self.unlisted:
                self.linked += len(data.strip())


def _kernel() -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    return k / k.sum()


def regions(lines: list[tuple[str, int, int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are in a cluster (smoothed ratio above the threshold), and which would be without their neighbours."""
    ratio = np.array([0.0 if f else max(0, len(t) - linked) / max(1, tags) for t, linked, tags, _, f in lines])
    padded = np.pad(ratio, RADIUS, mode="edge")
    smooth = np.convolve(padded, _kernel(), "valid")
    least = min(THRESHOLD * smooth.std(), smooth.max())
    hit = (smooth >= least) & (ratio > 0)
    return hit, hit & (ratio >= least)


def weighed(page: Lines) -> list[tuple[str, int, int, int, int]]:
    """The page's lines, with those in furniture by form or name for good that is not a wrapper of the page."""
    if not page.weighed:
        return page.out

    def inside(wrappers: set[int]) -> list[bool]:
        """For each container, whether it is in furniture that is no wrapper."""
        by: list[tuple[bool, bool]] = []  # in such a form, in such a name
        for c, box in enumerate(page.plain):  # parents come first
            form, name = by[page.parents[c]] if c else (False, False)
            if box[0] in ("article", "main"):
                form, name = False, name and box[0] == "article"
            if c in page.weighed and c not in wrappers:
                form, name = form or page.weighed[c] == "form", name or page.weighed[c] != "form"
            by.append((form, name))
        return [any(x) for x in by]

    shut = inside(set())
    if not any(box[0] in ("article", "main") and not shut[c] and c not in page.final for c, box in enumerate(page.plain)):
        held = _held(page, ((c, len(text)) for text, _, _, c, furniture in page.out if furniture < 2))
        shut = inside({c for c in page.weighed if held[c] > WRAPPER[page.weighed[c]] * held[0]})
    return [(t, linked, tags, c, 2 if shut[c] else f) for t, linked, tags, c, f in page.out]


def main_text(html: str | None) -> str:
    """The text of the page's article, a line for each block."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.line()
    page.total()
    page.out = weighed(page)
    # a layout name that would make furniture of most of a page without an article says something else ("has-sidebar")
    weights: dict[int, int] = {}
    for text, _, _, container, furniture in page.out:
        if furniture == 1:
            weights[page.named[container]] = weights.get(page.named[container], 0) + len(text)
    half = sum(len(t) for t, *_, f in page.out if f < 2) / 2
    if any(box[0] in ("article", "main") for box in page.plain):
        half = float("inf")
    lines = [(t, linked, tags, c, f > 1 or f == 1 and weights[page.named[c]] <= half) for t, linked, tags, c, f in page.out]
    if not any(not f for *_, f in lines):
        return ""
    hit, core = regions(lines)
    weight = _held(page, ((c, len(text)) for (text, _, _, c, _), h in zip(lines, hit, strict=True) if h))
    best = max((c for c, w in enumerate(weight) if w and w >= REGION_SHARE * weight[0] and page.plain[c][0] not in ("ul", "ol", "blockquote", "p", "li")), default=0)
    # without such an element nothing tells a lede or a closing beside the longest container from the rest of the article
    path = set(_ups(page, best))
    best = next((c for c in _ups(page, best) if page.plain[c][0] in ("article", "main")), 0)
    beside = set() if best else _beside(page, lines, core)
    keeps: list[bool] = []  # of each container, whether it is in the region and in no menu or block beside the article
    for c, box in enumerate(page.plain):
        above = c > 0 and keeps[page.parents[c]]
        keeps.append(c == best or above and (best > 0 or c in path or c not in beside and not _is_menu(box)))
    return "\n".join(text for text, _, _, container, furniture in lines if not furniture and keeps[container])


def _beside(page: Lines, lines: list[tuple[str, int, int, int, bool]], core: np.ndarray) -> set[int]:
    """Plain blocks without a line of a cluster's core, before the first heading or core line or after the last one."""
    hits = np.flatnonzero(core)
    if not hits.size:
        return set()
    first = min([hits[0], *(h for h in page.heads if h < len(lines) and not lines[h][4])])
    stays = [box[0] in PARTS and box[1] > 0 for box in page.plain]
    parts = list(stays)  # whether a container is in such a part
    for k, (text, linked, _, c, furniture) in enumerate(lines):
        if not furniture and (first <= k <= hits[-1] or linked < LINKED * len(text) and _SENTENCE.search(text)):
            stays[c] = True
    for c in range(len(stays) - 1, 0, -1):  # parents come first
        stays[page.parents[c]] |= stays[c]
    for c in range(1, len(parts)):
        parts[c] |= parts[page.parents[c]]
    return {c for c, box in enumerate(page.plain) if box[0] in PLAIN and not stays[c] and not parts[c]}


def _held(page: Lines, lines) -> list[int]:
    """Of each container, the text of those of the lines (container, length) that are in it."""
    held = [0] * len(page.plain)
    for c, n in lines:
        held[c] += n
    for c in range(len(held) - 1, 0, -1):
        held[page.parents[c]] += held[c]
    return held


def _ups(page: Lines, container: int):
    while container >= 0:
        yield container
        container = page.parents[container]


def _is_menu(box: list) -> bool:
    """Three links or more and hardly any other text."""
    return box[3] >= 3 and box[2] >= 0.8 * box[1]


def extract(pages: DataFrame, html_col: str = "html", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``text`` (empty if none) and ``n_chars``."""

    def make():
        def work(part, data, at):
            texts = [main_text(h) for h in part.column(html_col).to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return extend(pages, make, "text string, n_chars long", html_col, drop=drop)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), drop=("html",))
