"""Main text of web pages from streaming parser events and text-to-tag ratios.

The events of the standard parser become lines, one for each block of a page, with the
tags and the link text met in it. The ratio of text to tags of every line is smoothed
with a Gaussian along the page; lines above a threshold form the clusters of content.
The smallest element that is meant to hold an article and holds most of the
clustered text is the content region, and all of its lines belong to the text, short
ones too, but for parts that are marked as something else (menus, adverts, notices,
forms, comments of readers). A marked element round the title and clustered text of
its own is a wrapper of the article and is taken as if it were not marked; how much
text a part holds never makes it one. Time and memory are linear in the page, however
deep or malformed it is.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by what they mean for the text.
BLOCKS = frozenset(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary"
    " table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video select button textarea"
    " nav footer aside menu dialog".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset("article main section div td body".split())
CLOSES_P = BLOCKS - frozenset("body html option".split())
#: Words in a class, id or role that tell that an element is not part of the article.
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments"
    " complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr login masthead menu menubar"
    " modal nav navbar navigation newsletter notice notices notification outbrain paginate pagination paywall popup"
    " promo promoted promotion recommended related respond share sharebar sharing sidebar signup skip social sponsor"
    " sponsored subscribe subscription taboola teaser toolbar widget widgets".split()
)
WHITE = re.compile(r"[\x20\x09-\x0D]+")
SIGMA = 2.0
REACH = 4
MOST = 0.5
PIECE = 1 << 16


@dataclass
class Element:
    name: str
    number: int
    parent: Element | None
    skipped: bool
    region: bool
    marked: bool = False
    #: The innermost marked element, this one included.
    mark: Element | None = None
    #: Whether an element made for articles lies round it, with no mark between.
    article: bool = False

    def __post_init__(self):
        self.mark = self if self.marked else self.parent and self.parent.mark
        above = self.parent is not None and self.parent.article and not self.marked
        self.article = above or self.name in ("article", "main")


@dataclass
class Line:
    """The text of one block with what lies around it."""

    element: Element
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    link_chars: int = 0

    def text(self) -> str:
        return WHITE.sub(" ", "".join(self.parts)).strip(" ")


class Events(HTMLParser):
    """Turns parser events into lines; unclosed and wrongly nested elements are met as browsers do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", 0, None, False, True)
        self.stack, self.elements, self.lines = [self.root], [self.root], []
        #: Where open elements of a name, and of all blocks, lie in the stack.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.line = Line(self.root)
        self.links = 0

    def _push(self, element: Element) -> None:
        self.places[element.name].append(len(self.stack))
        if element.name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)
        self.elements.append(element)

    def _cut(self, place: int) -> None:
        """Close the open elements from a place of the stack on."""
        while len(self.stack) > place:
            element = self.stack.pop()
            self.places[element.name].pop()
            if element.name in BLOCKS:
                self.blocks.pop()

    def _last(self, names) -> int:
        """Place of the innermost open element of ``names``; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def _break(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
            self.line = Line(self.stack[-1])
        else:
            self.line.element = self.stack[-1]

    def _skipped(self, name: str, attrs) -> bool:
        """Whether an element never holds text of the article."""
        if name in NO_TEXT:
            return True
        if name == "header":
            # The heading of an article may stand in a header of its own.
            return not self._last(("article", "main"))
        given = dict(attrs)
        return "hidden" in given or given.get("aria-hidden") == "true"

    def _marked(self, name: str, attrs) -> bool:
        """Whether an element names itself as something else; a wrapper of the article may do so too."""
        if name == "form":
            return True
        given = dict(attrs)
        words = " ".join(given.get(k) or "" for k in ("class", "id", "role")).lower()
        return name not in ("html", "body") and not OTHER_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", words))

    def handle_starttag(self, name, attrs):
        if name in BLOCKS or name == "br":
            if name != "br":
                if name in CLOSES_P:
                    self._close_open(("p",), until=BLOCKS - {"p"})
                if name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                    same = {"li": ("li",), "option": ("option",), "tr": ("tr", "td", "th")}
                    self._close_open(same.get(name, ("dt", "dd") if name[0] == "d" else ("td", "th")), until={"ul", "ol", "dl", "table", "select"})
                self._break()
            else:
                self.line.parts.append(" ")
        if name == "body":
            inside = [self.places[n][0] for n in ("head", "title") if self.places[n]]
            if inside:
                self._cut(min(inside))
        self.line.tags += 1
        if name in VOID:
            return
        if name == "a":
            self.links += 1
        above = self.stack[-1]
        skipped = above.skipped or self._skipped(name, attrs)
        self._push(Element(name, len(self.elements), above, skipped, name in REGIONS, self._marked(name, attrs)))
        if name in BLOCKS:
            self.line.element = self.stack[-1]

    def _close_open(self, names, until) -> None:
        """Close the innermost open element of ``names`` if none of ``until`` lies above it."""
        place = self._last(names)
        if place > self._last(until):
            self._cut(place)

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)
        if name not in VOID:
            self.handle_endtag(name)

    def handle_endtag(self, name):
        if name in BLOCKS:
            self._break()
        if name == "a":
            self.links = max(0, self.links - 1)
        place = self._last((name,))
        # An inline element does not end a block.
        if place and (name in BLOCKS or not self.blocks or self.blocks[-1] < place):
            self._cut(place)
        if name in BLOCKS:
            self.line.element = self.stack[-1]
        self.line.tags += 1

    def handle_data(self, data):
        if self.stack[-1].skipped:
            return
        if not self.line.parts:
            self.line.element = self.stack[-1]
        self.line.parts.append(data)
        if self.links:
            self.line.link_chars += len(data.strip())


def lines_of(html: str) -> tuple[list[Line], list[Element]]:
    """Lines with text, in page order, and all elements; elements that never hold text of the article give no line."""
    events = Events()
    for i in range(0, len(html), PIECE):
        events.feed(html[i : i + PIECE])
    events.close()
    events._break()
    return [line for line in events.lines if line.text()], events.elements


def content_lines(lines: list[Line], sigma: float = SIGMA, reach: int = REACH) -> list[bool]:
    """Which lines lie in a cluster: the smoothed text-to-tag ratio is at the threshold or above."""
    ratios = [(len(x.text()) - x.link_chars) / max(1, x.tags) for x in lines]
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(ratios)):
        near = [(weights[j + reach], ratios[i + j]) for j in range(-reach, reach + 1) if 0 <= i + j < len(ratios)]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    if not smooth:
        return []
    mean = sum(smooth) / len(smooth)
    deviation = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    threshold = min(deviation, mean)
    return [s >= threshold for s in smooth]


def _region(lines: list[Line], elements: list[Element], most: float = MOST) -> int:
    """Number of the element that holds the article."""
    weight = [0] * len(elements)
    for line, inside in zip(lines, content_lines(lines)):
        if inside:
            weight[line.element.number] += len(line.text())
    # Elements are numbered as they open, so an inner one comes before those round it here.
    for element in reversed(elements):
        if element.parent is not None:
            weight[element.parent.number] += weight[element.number]
    total = weight[0]
    held = [e for e in elements if e.region and weight[e.number]]
    # An element made for articles, the outermost one, before any that may hold one.
    for name in ("article", "main"):
        fit = [e.number for e in held if e.name == name and weight[e.number] >= most * total]
        if fit:
            return min(fit)
    return max((e.number for e in held if weight[e.number] >= 0.9 * total), default=0)


def _first_large(places: list[int], text: dict[int, int], free: float, most: float) -> list[int]:
    """The place without a mark if it has a share ``free`` of the largest, else the first that has ``most``."""
    top = max((text[p] for p in places), default=0)
    if 0 in places and text[0] >= free * top:
        return [0]
    return [p for p in places if text[p] and text[p] >= most * top][:1]


def _wrappers(lines: list[Line], most: float = MOST) -> set[int]:
    """Numbers of the marked elements that lie round the article.

    Lines belong to their innermost mark, if they have one. The article is where a title
    (h1) and clustered text belong to the same mark, or to none: of several such places, the one
    with the most. Without a title another heading will do; then no mark comes before all
    marks, and of those the first that is not much smaller than the rest. Without a heading it
    is the first place with text in an element made for articles, and without one no mark, or the first mark
    that is not much smaller than the rest.
    """
    text: defaultdict[int, int] = defaultdict(int)
    marks: dict[int, Element | None] = {}
    titled: dict[int, None] = {}
    headed: dict[int, None] = {}
    named: dict[int, None] = {}
    for line, inside in zip(lines, content_lines(lines)):
        mark = line.element.mark
        place = 0 if mark is None else mark.number
        marks[place] = mark
        if line.element.name in HEADINGS:
            headed[place] = None
            if line.element.name == "h1":
                titled[place] = None
        elif inside:
            text[place] += len(line.text())
            if line.element.article:
                named[place] = None
    places = [p for p in titled if text[p]]
    if not places:
        places = _first_large([p for p in headed if text[p]], text, 0.0, most)
    places = places or list(named)[:1] or _first_large(list(text), text, 0.1, most)
    found: set[int] = set()
    mark = marks[max(places, key=lambda p: (text[p], -p))] if places else None
    while mark is not None:
        found.add(mark.number)
        mark = mark.parent and mark.parent.mark
    return found


def _unmarked(lines: list[Line]) -> list[Line]:
    """The lines that lie in no marked element but wrappers of the article."""
    wrappers = _wrappers(lines)
    return [x for x in lines if x.element.mark is None or x.element.mark.number in wrappers]


def main_text(html: str) -> str:
    """The article of a page: its blocks in page order, joined by an empty line; empty if there is none."""
    lines, elements = lines_of(html)
    lines = _unmarked(lines)
    if not lines:
        return ""
    region = _region(lines, elements)
    within = [False] * len(elements)
    for element in elements:
        within[element.number] = element.number == region or (element.parent is not None and within[element.parent.number])
    return "\n\n".join(line.text() for line in lines if within[line.element.number])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per input row.

    A null html is empty; a page without text gives an empty text. Ids and urls come
    back as they are, nulls and repeats too. Pages are independent of each other,
    so nothing is shuffled. An empty table gives no rows. Pages of any length and depth are taken
    whole, in time linear in their length. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            text = [main_text(html or "") for html in batch["html"]]
            yield pd.DataFrame(
                {"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]}
            )

    # Ids travel as text: integers beside nulls would become floats in pandas.
    rows = pages.select(
        F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    found = rows.mapInPandas(run, "page_id string, url string, text string, n_chars bigint")
    return found.withColumn("page_id", F.col("page_id").cast(pages.schema[id_col].dataType))
