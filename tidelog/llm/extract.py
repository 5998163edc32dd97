"""HTML extraction: flat text blocks, judged by a decision tree.

A page becomes a list of text blocks in page order, without a tree of elements.
Each block has its word count and link density, those of its neighbours, and
marks of the elements around it.  A decision tree, grown here on the small labelled
table below, tells article text from the rest: by marks where a page has an
article or main element, by counts and densities where it has none.

Edge cases: a null or empty page gives an empty text.  An element, comment or tag
that the page leaves open ends with the page; an unfinished tag at the end is
dropped, and a character reference without its semicolon is decoded where HTML
allows it.  Every character is read a bounded number of times, so that very long
pages, also of broken or deeply nested markup, take time in proportion to their
length; one page is held in memory at a time.  page_id and url may be null; repeated
rows are judged one by one.  Extra columns, whatever their names, are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import sliced, texts_of

# HTML element names by kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. Those of RAW_TEXT last to the page's end if they are left open.
RAW = frozenset("script style template noscript iframe object svg math canvas textarea title".split())
RAW_TEXT = frozenset("script style iframe textarea title".split())
#: Those of RAW that a slash before their tag's end closes.
FOREIGN = frozenset(("svg", "math"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BOILER = frozenset("nav header footer aside form menu button select fieldset dialog".split())
#: Elements that the next of their kind closes, unless one of these was opened since.
CLOSED_BY_NEXT = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Class, id and role values that mark what is not the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus disclaimer footer header legal masthead menu nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: A value of several words marks it too if it has a word of HINTS and none but such and these: site-footer, but not related-work or page-header.
FRAME = frozenset("area article articles bar block body bottom box button buttons container entry form global icons inner item items left link links list main modal outer overlay panel post posts primary reader readers right secondary section site slot sticky stories top unit user wrap wrapper".split())
#: Those of BOILER that may stand around a whole page.
FORMS = frozenset(("form", "fieldset"))
MAIN = frozenset(("article", "main", "body", "html"))
#: The only values that mark one of these elements itself.
MAIN_HINTS = frozenset(("ad", "advert", "advertisement", "comment", "comment-body", "promo", "reply", "sponsored", "teaser"))

#: A quote opens a value only behind "="; elsewhere it is a character like others, and the first ">" ends the tag.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
_NAMED = re.compile("class|id|role", re.IGNORECASE | re.ASCII)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+")
_BORDER = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.IGNORECASE | re.ASCII) for name in RAW}


@dataclass(frozen=True, eq=False)
class Unit:
    """An article or main element (of an article in main, the article), with the marks open around it."""

    name: str
    elements: int
    forms: int
    whole: int
    parts: int


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    boiler: bool
    hinted: bool
    heading: bool
    unit: Unit | None = None
    #: boiler and hinted by the marks within the unit alone.
    inner: tuple[bool, bool] = (False, False)

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@cache
def _split(value: str) -> frozenset[str]:
    """The words of HINTS in a value of several words, if all others are of FRAME."""
    words = [w.lower() for w in _WORD.findall(value)]
    hints = HINTS.intersection(words)
    return frozenset(hints) if len(words) > 1 and FRAME.union(HINTS).issuperset(words) else frozenset()


def _hints(name: str, attributes: str) -> tuple[set[str], set[str]]:
    """The words of HINTS that are whole values of class, id or role, and those in values of several words."""
    if not _NAMED.search(attributes):
        return set(), set()
    values = [v for key, *found in _ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id", "role") for v in "".join(found).split()]
    if name in MAIN:
        return set(MAIN_HINTS.intersection(map(str.lower, values))), set()
    whole = set(HINTS.intersection(map(str.lower, values)))
    parts = set().union(*(_split(v) for v in values if len(v) < 80))
    return whole, parts - whole


class _Open:
    """An open element with the marks that it adds; closed is set where its end came before that of elements in it."""

    __slots__ = ("name", "added", "head", "unit", "closed")

    def __init__(self, name: str, added: tuple[int, ...], head: bool, unit: Unit | None):
        self.name, self.added, self.head, self.unit, self.closed = name, added, head, unit, False


class _Reader:
    """Collects blocks; keeps the names of open elements with the marks that they add."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open: list[_Open] = []
        #: Places in open, by name, and of all blocks.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.block_places: list[int] = []
        self.parts: list[tuple[str, bool]] = []
        self.links = self.articles = 0
        #: Open marks: elements of BOILER without forms, forms, whole hints, hints in parts of names.
        self.marks = (0, 0, 0, 0)
        #: Those of marks that come from an article's header, in which its title may stand.
        self.heads = (0, 0, 0, 0)
        self.unit: Unit | None = None

    def text(self, raw: str) -> None:
        self.parts.append((raw, self.links > 0))

    def flush(self) -> None:
        if not self.parts:
            return
        # References are decoded over the whole block, so that one next to markup is left as HTML has it.
        texts = [(html.unescape(raw), link) for raw, link in self.parts]
        self.parts = []
        words = "".join(t for t, _ in texts).split()
        if words:
            linked = sum(len(t.split()) for t, link in texts if link)
            title = bool(self.places["h1"] or self.places["h2"])
            elements, forms, whole, parts = (m - h for m, h in zip(self.marks, self.heads, strict=True)) if title else self.marks
            unit = self.unit
            inner = (elements + forms > unit.elements + unit.forms, whole + parts > unit.whole + unit.parts) if unit else (False, False)
            heading = any(self.places[h] for h in HEADINGS)
            self.blocks.append(Block(" ".join(words), len(words), min(linked, len(words)), self.articles > 0, elements + forms > 0, whole + parts > 0, heading, unit, inner))

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
            if self.places["p"] and self.places["p"][-1] == self.block_places[-1]:
                self._close_to(self.places["p"][-1])
            if name in CLOSED_BY_NEXT and self.places[name] and self.places[name][-1] > max((self.places[o][-1] for o in CLOSED_BY_NEXT[name] if self.places[o]), default=-1):
                self._close_to(self.places[name][-1])
        elif name == "a" and self.places["a"]:
            self.end("a")
        if name == "br":
            self.text(" ")
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            return
        whole, parts = _hints(name, attributes) if attributes else (set(), set())
        added = (int(name in BOILER and name not in FORMS), int(name in FORMS), int(bool(whole)), int(bool(parts) and not whole))
        head = self.articles > 0 and (name == "header" or name not in BOILER) and whole | parts <= {"header"} and any(added)
        self.places[name].append(len(self.open))
        if name in BLOCKS:
            self.block_places.append(len(self.open))
        self.open.append(_Open(name, added, head, self.unit))
        if name in ("article", "main"):
            self.articles += 1
            if self.unit is None or name == "article" and self.unit.name == "main":
                self.unit = Unit(name, *self.marks)
        self.links += name == "a"
        if any(added):
            self._mark(added, head, 1)

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if name == "br":
            self.text(" ")
        elif self.places[name]:
            at = self.places[name][-1]
            if name not in BLOCKS and self.block_places and self.block_places[-1] > at:
                # The end of an inline element leaves the blocks that were opened in it as they are.
                self.places[name].pop()
                self._undo(self.open[at])
            else:
                self._close_to(at)

    def _mark(self, added: tuple[int, ...], head: bool, sign: int) -> None:
        self.marks = tuple(m + sign * a for m, a in zip(self.marks, added, strict=True))
        if head:
            self.heads = tuple(m + sign * a for m, a in zip(self.heads, added, strict=True))

    def _undo(self, closed: _Open) -> None:
        closed.closed = True
        self.links -= closed.name == "a"
        self.articles -= closed.name in ("article", "main")
        if any(closed.added):
            self._mark(closed.added, closed.head, -1)

    def _close_to(self, at: int) -> None:
        """Closes the open elements from the last to that at place at."""
        while len(self.open) > at:
            closed = self.open.pop()
            if closed.name in BLOCKS:
                self.block_places.pop()
                self.unit = closed.unit
            if not closed.closed:
                self.places[closed.name].pop()
                self._undo(closed)


class _Skipper:
    """Finds the ends of elements whose content is skipped, reading each page about once per name."""

    def __init__(self, page: str):
        self.page = page
        self.endless: set[str] = set()
        self.unbalanced: set[str] = set()

    def behind(self, name: str, at: int) -> int:
        """The place behind the end tag of the element name that was opened before at; at itself where there is none."""
        if name in self.endless:
            return at
        depth, first = 1, None
        for m in _BORDER[name].finditer(self.page, at):
            if not m[1] and (name in RAW_TEXT or name in self.unbalanced):
                continue
            close = self.page.find(">", m.end())
            if close < 0:
                break
            if m[1]:
                depth -= 1
                first = first or close + 1
                if not depth or name in self.unbalanced:
                    return close + 1
            elif self.page[close - 1] != "/":
                depth += 1
        if first is None:
            self.endless.add(name)
            return len(self.page) if name in RAW_TEXT else at
        self.unbalanced.add(name)
        return first


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page, in order."""
    page = page or ""
    reader, skipper, at, text_at = _Reader(), _Skipper(page), 0, 0
    while (at := page.find("<", at)) >= 0:
        kind = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = 5 if page.startswith("<!-->", at) else 6 if page.startswith("<!--->", at) else 0
            stop = at + end if end else page.find("-->", at + 4) + 3
            m = None
            stop = stop if end or stop > 2 else len(page)
        elif kind.isascii() and kind.isalpha() or kind == "/" and page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha():
            m = _TAG.match(page, at)
            # A tag without an end lasts to the end of the page.
            stop = m.end() if m else len(page)
        elif kind and kind in "!?/":
            m, stop = None, page.find(">", at) + 1 or len(page)
        else:
            at += 1
            continue
        if at > text_at:
            reader.text(page[text_at:at])
        at = text_at = stop
        if m is None:
            continue
        name = m[2].lower()
        if m[1]:
            reader.end(name)
        elif name in FOREIGN and m[3].endswith("/"):
            continue
        elif name in RAW:
            if name in BLOCKS:
                reader.flush()
            at = text_at = skipper.behind(name, at)
        else:
            reader.start(name, m[3] or "")
    if text_at < len(page):
        reader.text(page[text_at:])
    reader.flush()
    return reader.blocks


def unframed(found: list[Block]) -> list[Block]:
    """found, with the article free of the marks around it if all articles of the page stand in such marks.

    It is the article with the fewest of them (a main if there is no article).  Marks like aside
    stay with an article, as do whole hints with more than one, as of comments; and all stay if the
    text outside of marks is longer than the article, which is then a side matter of its page.
    """
    clean = [b for b in found if b.unit and not any(b.inner)]
    units = {b.unit for b in clean if b.unit.name == "article"} or {b.unit for b in clean}
    least = min(((u.elements if u.name == "article" else 0, u.whole, u.forms + u.parts) for u in units), default=(0, 0, 0))
    freed = {u for u in units if (u.elements if u.name == "article" else 0, u.whole, u.forms + u.parts) == least}
    if least[0] or least[1] and len(freed) > 1 or not any(u.elements + u.forms + u.whole + u.parts for u in freed):
        return found
    if sum(b.words for b in clean if b.unit in freed) <= sum(b.words - b.linked for b in found if not b.boiler and not b.hinted and b.unit not in freed):
        return found
    return [replace(b, boiler=b.inner[0], hinted=b.inner[1]) if b.unit in freed else b for b in found]


#: Blocks on each side of a block in which its longest neighbour is looked for.
NEAR = 3
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "most_before", "most_after", "heading", "article", "boiler", "hinted", "page_article")
COUNTS, MARKS = range(9), range(9, 13)


def features(found: list[Block]) -> np.ndarray:
    """One row per block: its word count and link density and its two neighbours', the most unlinked words of the NEAR blocks on each side, and its marks (zero beyond the page)."""
    n = len(found)
    own = np.array([(b.words, b.density) for b in found], dtype=float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    free = np.array([b.words - b.linked if not (b.boiler or b.hinted) else 0 for b in found], dtype=float)
    padded = np.r_[np.zeros(NEAR), free, np.zeros(NEAR)]
    before = np.max([padded[k : k + n] for k in range(NEAR)], axis=0)
    after = np.max([padded[NEAR + 1 + k : NEAR + 1 + k + n] for k in range(NEAR)], axis=0)
    parted = any(b.article and not b.hinted for b in found)
    marks = np.array([(b.heading, b.article, b.boiler, b.hinted, parted) for b in found], dtype=float).reshape(-1, 5)
    return np.hstack([own, np.vstack([edge, own])[:-1], np.vstack([own, edge])[1:], before[:, None], after[:, None], marks])


#: Labelled pages, a block each word: + (article text) or -, words, / words in links if any, and marks (a: in an article, b: in an element like nav,
#: n: in a named part like a sidebar, h: heading).
LABELLED = (
    # With an article: what stands in it, however short or linked, but for its marked parts.
    "-1/1b -1/1b -2b -15n +4ah +12a +1a +6/5a -8b",
    "-10b +1ah +13a +1a +2a -2n +3a +1a +1a -12b",
    "-14n +1a +2a +3/3a -12an -2b -15b",
    "-7ab +1ah +13a -9ab -3/3n -1n",
    "+2a",
    "-26 +1ah +2a -2ahn -22an -24ab +2a -20an -1h -21",
    "+1ah +2/2a +2/2a +2a -1",
    "-3/3 -2/2 -12 +5ah +40a +3ah +30/4a +2a -20/2 -2/2",
    "-30 -2/2 +60a +5/5a +55a +1a +4/4a -35 -4h -28",
    "-18an +9a +2/1a -4/4ab -14ab",
    # Marked parts of pages without one, of any length.
    "-3hn -31n +29 -3bh -33b +26 -3hn -30n -28b",
    "-31b +5h +26 -29n -30b",
    "-2b -2/2b +3h +45 +52 -20n -1n -18b -9/3b",
    "-14n -3/3n +8h +25 +2h +31 -5n -40n -6b",
    "-4hb -40b +3h +38 +27 -3n -3/3n -2/2n -35b",
    # Frames of links around paragraphs.
    "-1/1 -1/1 -2/2 +5h +41 +62/2 +33 -1/1 -2/2 -3/3",
    "-6/4 -2/2 +3h +28 +30 -6/6 -4/4 -2/2",
    "-3/3 -3/3 +21 +22 -5/5 -1",
    "-1/1 -2/2 -1/1 -1/1 +6h +24/1 +2h +37 +19/2 +3h +44 -2h -7/7 -6/6 -9/9",
    "-2/2 -2/2 -6 -3/3 +5h +55 +48/5 -3h -8/8 -7/7 -2/2 -1/1 -9",
    "-1/1 -2/2 -9/8 +57 +34 +81/3 -12/9 -2/2 -8",
    "-4/4 -2/2 -2/2 +7h +3 +42 +16 +50 -4 -2/2 -2/2 -7",
    "-2/2 -3/2 -1/1 +4h +70/9 +66/20 +31 -10/10 -9/9 -11/11 -2/2",
    # Short paragraphs, lists, cells and verse between longer ones or in rows of unlinked text.
    "+40 +3 +2 +5 +38",
    "+3h +12",
    "+3h +36",
    "+60 +1h +35",
    "+1h +51 +1h +44 +1h +29",
    "+2h +24 +1h +3 +66 +2h +31",
    "-1/1 -2/2 +1h +33 +57 +1h +48 -2/2 -1/1",
    "+70 +65",
    "-2/2 -1/1 +64 +2h +39 +1h +45 -3",
    "+4h +33 +2h +6 +9 +4 +45 +1h +7 +8 +6 +28",
    "-2/2 -1/1 -2/2 +3h +7 +6 +8 +7 +5 +8 +6 +7 -2/2 -3/3",
    "-1/1 -1/1 +2h +6 +7 +6 +7 +6 +8 -3/3 -2/2 -5",
    "-2/2 -2/2 +5h +26 +1 +2 +1 +2 +1 +3 +27 -2/2 -2/2 -6",
    "-1/1 -3/3 -1/1 +4h +14 +11 +17 +9 +13 -2/2 -4/4",
    "-2/2 -2/2 +6h +20 +5 +18 +4 +25 +8/1 +22 -2/2 -1/1",
    "+5h +2 +48 +39 +52 +41",
    "+2h +9 +8 +11 +10",
    # Titles that are no headings, behind links.
    "-3/3 -2/2 +6 +43 +37 -2/2",
    "-2/2 +9 +58",
    "-1/1 -1/1 +7 +25 +4 +31 -3/3",
    # Unlinked words of the frame: at the top and the bottom, next to links or far from any paragraph.
    "-1 -1 -2 -1 -2/2 +5h +50 +43 -2/2 -3 -2/2 -2",
    "-2 -3/3 -1 +46 +29 -1/1 -3 -1/1 -5",
    "-3/3 -2 -2/2 -2 -2/2 -1 -2/2",
    "-2h -6/6 -7/7 -5/5 -8/8 -2/2",
    "-2/2 -8 -2/2 -2/2 +4h +30 +38 -3h -6/6 -2 -7/7 -3 -5/5 -2",
)
#: The tree's least leaf and most depth.
LEAF, DEPTH = 2, 10


def page_of(row: str) -> tuple[list[Block], list[int]]:
    """The blocks of one row of LABELLED, and their labels."""
    found, labels = [], []
    for cell in row.split():
        m = re.fullmatch(r"([+-])(\d+)(?:/(\d+))?([abnh]*)", cell)
        found.append(Block("", int(m[2]), int(m[3] or 0), *(c in m[4] for c in "abnh")))
        labels.append(int(m[1] == "+"))
    return found, labels


@cache
def tree() -> tuple:
    """The decision tree, grown on LABELLED by Gini impurity: (feature, value, left, right) or a leaf's share of article text."""
    told = [page_of(row) for row in LABELLED]
    x = np.vstack([features(found) for found, _ in told])
    y = np.array([label for _, labels in told for label in labels], dtype=float)

    def impurity(part: np.ndarray) -> float:
        return 2 * part.mean() * (1 - part.mean()) * len(part) if len(part) else 0.0

    def grow(rows: np.ndarray, depth: int, chosen: range) -> tuple | float:
        own = y[rows]
        if own.min() == own.max() or depth == DEPTH:
            return float(own.mean())
        best = (impurity(own) - 1e-9, None, None)
        for f in chosen:
            values = np.unique(x[rows, f])
            for v in (values[1:] + values[:-1]) / 2:
                left = x[rows, f] < v
                if min(left.sum(), (~left).sum()) < LEAF:
                    continue
                cost = impurity(own[left]) + impurity(own[~left])
                if cost < best[0] - 1e-9:
                    best = (cost, f, float(v))
        _, f, v = best
        if f is None:
            # Marks tell for certain where they tell anything, so counts and densities part what they leave.
            return grow(rows, depth, COUNTS) if chosen is MARKS else float(own.mean())
        left = x[rows, f] < v
        return f, v, grow(rows[left], depth + 1, chosen), grow(rows[~left], depth + 1, chosen)

    return grow(np.arange(len(y)), 0, MARKS)


def is_article(row: np.ndarray) -> bool:
    node = tree()
    while isinstance(node, tuple):
        f, v, left, right = node
        node = left if row[f] < v else right
    return node >= 0.5


def main_text(page: str | None) -> str:
    """The article's blocks, one per line."""
    found = blocks(page)
    kept = [is_article(row) for row in features(found)]
    freed = unframed(found)
    if freed is not found:
        # What the page has without its frame's marks comes on top of what it has with them.
        kept = [k or is_article(row) for k, row in zip(kept, features(freed), strict=True)]
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages."""

    def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [main_text(page) for page in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
