"""Main text of web pages: text-to-tag ratios of lines, smoothed and clustered.

The standard library's parser streams events over the whole page. They make lines:
the text between two boundaries of block elements, with the number of tags and the
characters inside links. A line's ratio is its text outside links per tag; lines
inside elements that are never content (by element, role, class or id) have ratio 0.
A longer class or id counts if its other words say nothing of their own (``site-footer``,
but not ``login-steps``); inside an article or main element only a whole class does. Any
other listed word of a class or id, which may come from a title, is a doubt: its lines
have ratio 0, yet belong to the region they lie in. If every article is hidden by a menu,
header, footer or sidebar, that element was not closed, and the article ends it.
The ratios are smoothed with a Gaussian and split into two clusters by the threshold
that separates them best (two means in one dimension); lines above it are content.

Content regions are widened to what holds them: the innermost article, main or
content element with all content lines gives all of its lines, or an article or main
element with much of the text, if the rest lies in no other such element; without one,
the lines from the first to the last content line and, on both sides of them, those that
are plain text and not mostly links. Doubtful lines beside the article
that holds all content are left out. In a region every line outside the
never-content elements is text, however short. White space in a line becomes one
space, lines are trimmed, empty ones go, and the rest is joined by line breaks.
``br`` is white space inside a line. Character references are decoded once.

Defined results: a missing or empty page, and one without text, gives the empty
string; broken markup is read as the parser reads it, unclosed elements end with what
encloses them; repeated rows give equal texts. Extra columns pass through; columns
named ``text`` or ``n_chars`` are replaced. An empty table gives an empty one. Everything happens row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import prepared, slices

SLICE = 4 << 20
CHUNK = 1 << 16

# Element names and words of classes and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript "
    "ol option p pre script section select style summary table tbody td template textarea tfoot th thead title tr ul".split()
)
NEVER = frozenset(
    "aside button dialog footer form head iframe input menu nav noscript object option script select style svg "
    "template textarea title".split()
)
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NEVER_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "discussion disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "overlay pagination pager popup promo promotion related replies reply respond responses search share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
CONTENT = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article content entry main post story".split())
#: Of those, what an article or main element itself may be.
NEVER_CONTENT = frozenset("ad ads advert comment comments promo related replies reply responses sponsored teaser widget".split())
#: Words that do not change what a listed word beside them says of an element.
NEUTRAL = frozenset(
    "area bar block bottom box button buttons column container fixed float floating form global group header icon icons inner item items "
    "left link links list main mobile outer page panel post posts primary right row secondary section site slot sticky top unit wrap wrapper".split()
)
#: Elements that a page may forget to close before its article.
UNCLOSED = frozenset("aside footer header menu nav".split())
#: Classes of these prefixes tell what a page has, not what an element is.
TELLS = re.compile(r"(?:has|with|without|no|is|js)[-_]")
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
LISTS = frozenset(("ul", "ol", "dl", "menu", "table", "select"))
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Lines of a page, from parser events."""

    def __init__(self, forgiving: bool = False):
        super().__init__(convert_charrefs=True)
        self.forgiving = forgiving  # whether an article or main element closes what hides it
        self.lost = False  # whether one was hidden by such an element
        self.stack: list[tuple[str, int, int, int, int]] = []  # element; depths of never, doubt, links; its container
        self.never = self.doubt = self.link = 0
        self.container = 0
        self.parents = [0]
        self.named = [False]  # whether a container is an article or main element
        self.within = [False]  # whether it is such an element or lies in one
        self.articles = [False]  # whether it is an article or lies in one
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.links: list[int] = []
        self.hidden: list[bool] = []
        self.doubtful: list[bool] = []
        self.inside: list[int] = []
        self.parts: list[str] = []
        self.count = self.linked = 0

    def cut(self) -> None:
        """A block boundary: what came since the last one is a line."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.texts.append(text)
                self.tags.append(self.count)
                self.links.append(self.linked)
                self.hidden.append(self.never > 0)
                self.doubtful.append(self.doubt > 0)
                self.inside.append(self.container)
                self.count = 0
            self.parts, self.linked = [], 0

    def _leave(self, place: int) -> None:
        _, self.never, self.doubt, self.link, self.container = self.stack[place]
        del self.stack[place:]

    def _uncover(self) -> None:
        """An article starts inside an element that hides it and may not have been closed."""
        for place, (name, never, *_) in enumerate(self.stack):
            if name in UNCLOSED and not never:
                self.lost = True
                if self.forgiving:
                    self._leave(place)
                return

    def _close_open(self, names: tuple[str, ...], stops: frozenset[str]) -> None:
        for place in range(len(self.stack) - 1, -1, -1):
            name = self.stack[place][0]
            if name in names:
                self._leave(place)
                return
            if name in stops:
                return

    def handle_starttag(self, tag, attrs):
        self.count += 1
        if tag in BLOCKS:
            self.cut()
            self._close_open(("p",), BLOCKS - {"p"})
            if tag in CLOSES:
                self._close_open(CLOSES[tag], LISTS)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CONTENT and self.never:
            self._uncover()
        words, classes, marks, role = [], [], [], None
        for name, value in attrs:
            if value and name in ("class", "id"):
                for one in value.lower().split():
                    if not TELLS.match(one):
                        parts = [w for w in re.split(r"[^a-z0-9]+", one) if w]
                        words += parts
                        marks.append(parts)
                        if name == "class":
                            classes.append(one)
            elif name == "role":
                role = (value or "").lower()
        within = self.within[self.container]
        self.stack.append((tag, self.never, self.doubt, self.link, self.container))
        content = tag in CONTENT or role == "main"
        listed = NEVER_CONTENT if content else NEVER_WORDS
        # A header that belongs to an article holds its title.
        if tag == "header" and within:
            listed = listed - {"header"}
        told = not listed.isdisjoint(words)
        # A longer name is certain outside of articles if its other words say nothing of their own.
        plain = any(not listed.isdisjoint(m) and all(w in listed or w in NEUTRAL or w.isdigit() for w in m) for m in marks)
        certain = not listed.isdisjoint(classes) if within else plain
        never = tag in NEVER or role in NEVER_ROLES or certain or tag == "header" and not within
        if tag in ("html", "body"):
            never = told = False
        if never:
            self.never += 1
        elif told:
            self.doubt += 1
        if not never and (content or tag not in ("html", "body") and not CONTENT_WORDS.isdisjoint(words)):
            self.parents.append(self.container)
            self.named.append(content)
            self.within.append(content or within)
            self.articles.append(tag == "article" or self.articles[self.container])
            self.container = len(self.parents) - 1
        if tag == "a":
            self.link += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.count += 1
        if tag in BLOCKS:
            self.cut()
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place][0] == tag:
                self._leave(place)
                return

    def handle_data(self, data):
        self.parts.append(data)
        if self.link:
            self.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over lines, weights renormalised at the ends."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weights


def threshold(values: np.ndarray) -> float:
    """The cut between two clusters with the least squared error; the minimum if all are equal."""
    ordered = np.sort(values)
    if ordered[0] == ordered[-1]:
        return float(ordered[0])
    n = np.arange(1, len(ordered))
    total = np.cumsum(ordered)
    between = total[:-1] ** 2 / n + (total[-1] - total[:-1]) ** 2 / (len(ordered) - n)
    at = int(np.argmax(between))
    return float((ordered[at] + ordered[at + 1]) / 2)


def _region(page: Lines, content: np.ndarray) -> np.ndarray:
    """Which lines lie in the content regions."""
    sizes = np.array([len(text) for text in page.texts])
    held, doubt = np.zeros(len(page.parents)), np.zeros(len(page.parents))
    np.add.at(held, np.array(page.inside), sizes * content)
    np.add.at(doubt, np.array(page.inside), sizes * (np.array(page.doubtful) & ~np.array(page.hidden)))
    for child in range(len(page.parents) - 1, 0, -1):  # children come after their parents
        held[page.parents[child]] += held[child]
        doubt[page.parents[child]] += doubt[child]
    children: list[list[int]] = [[] for _ in page.parents]
    for child in range(1, len(page.parents)):
        children[page.parents[child]].append(child)
    # Containers with all their content lines in one article.
    whole = [page.articles[c] for c in range(len(page.parents))]
    for c in range(len(page.parents) - 1, -1, -1):
        whole[c] = whole[c] or any(whole[child] and held[child] == held[c] for child in children[c])
    chosen, total = 0, held[0]
    while True:
        inner = sorted(children[chosen], key=lambda c: -held[c])
        if not inner or not held[inner[0]]:
            break
        best = inner[0]
        # Outside of articles, one holds the text even beside long unmarked rest, unless other containers have some.
        alone = page.named[best] and held[best] >= 0.3 * total and not chosen and (len(inner) == 1 or not held[inner[1]])
        if held[best] < held[chosen] and not alone:
            break
        # Doubtful lines beside an article are not part of it; those in one are.
        if doubt[best] < doubt[chosen] and (page.articles[chosen] or not whole[best]):
            break
        chosen = best
    if chosen:
        within = np.zeros(len(page.parents), dtype=bool)
        within[chosen] = True
        for container in range(chosen + 1, len(page.parents)):
            within[container] = within[page.parents[container]]
        return within[np.array(page.inside)]
    # Without a container: from the first to the last content line, and on to either side over plain text.
    visible = np.flatnonzero(~np.array(page.hidden) & ~np.array(page.doubtful))
    own = content[visible]
    plain = (2 * np.array(page.links) < sizes)[visible]
    first, last = np.flatnonzero(own)[[0, -1]]
    while first > 0 and plain[first - 1]:
        first -= 1
    while last + 1 < len(own) and plain[last + 1]:
        last += 1
    within = np.zeros(len(sizes), dtype=bool)
    within[visible[first : last + 1]] = True
    return within


def _lines(html: str, forgiving: bool = False) -> Lines:
    page = Lines(forgiving)
    for start in range(0, len(html), CHUNK):
        page.feed(html[start : start + CHUNK])
    page.close()
    page.cut()
    return page


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = _lines(html)
    if page.lost and not any(page.named[c] and not h for c, h in zip(page.inside, page.hidden)):
        # Every article is hidden: what hides it was not closed.
        page = _lines(html, forgiving=True)
    hidden = np.array(page.hidden, dtype=bool)
    if not len(hidden) or hidden.all():
        return ""
    sizes = np.array([len(text) for text in page.texts], dtype=float)
    outside = np.maximum(sizes - np.array(page.links), 0)
    doubtful = np.array(page.doubtful, dtype=bool)
    ratios = np.where(hidden | doubtful, 0.0, outside / np.maximum(page.tags, 1))
    smooth = smoothed(ratios, sigma)
    content = (smooth >= threshold(smooth)) & ~hidden & ~doubtful
    if not content.any():
        content = ~hidden & ~doubtful if (~hidden & ~doubtful).any() else ~hidden
        if doubtful[content].any():
            page.doubtful = [False] * len(hidden)
    keep = _region(page, content) & ~hidden
    return "\n".join(text for text, kept in zip(page.texts, keep) if kept)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and its length in code points, ``n_chars``; without the markup."""
    kept = pages.select(*[f"`{c}`" for c in pages.columns if c.lower() not in ("text", "n_chars") or c == html])
    prepared(pages.sparkSession)
    place = kept.columns.index(html)
    rest = [f for f in kept.schema.fields if f.name != html]
    schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html, SLICE):
            texts = [main_text(page) for page in batch.column(place).to_pylist()]
            columns = [column for n, column in enumerate(batch.columns) if n != place]
            names = [name for n, name in enumerate(batch.schema.names) if n != place]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*names, "text", "n_chars"],
            )

    return kept.mapInArrow(run, schema)


def query(pages: DataFrame) -> DataFrame:
    return extracted(pages.select("page_id", "url", "html"))
