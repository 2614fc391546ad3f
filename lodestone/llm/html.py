"""Main-text extraction from web pages by the line-block distribution.

A page is cut into lines, one for each block element. Menus, forms, scripts and the like are stripped by their element
names, and parts that are marked as an advert, a sidebar or comments by their marks. Each line left weighs the characters
of its text outside links. The sums of the weights over a sliding window of lines form the line-block distribution: a
stretch of text starts where it surges and ends where it dives to nothing, and all lines between are kept. What is a
surge follows from the page: a share of what a window of its lines holds on average, SURGE characters at most.

If a page marks an article that holds most of its text, that mark is better evidence than any length: only its lines
weigh, those of nothing but links, too, unless they are items of lists, and anything above nothing is a surge there. So
on such pages the distribution only takes lists of links out. If nothing surges, all lines that could weigh are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element names by their role, and words that mark a part as no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea iframe template svg math object canvas".split())
ASIDE = frozenset("head title nav header footer aside form button select menu dialog fieldset figure-menu".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th"
    " thead title tr ul".split()
)
CLOSES_SELF = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
MARKED_ASIDE = re.compile(
    r"(?<![a-z])(ads?|adverts?|advertisement|advertising|sponsor(ed)?|promo(tion)?|banner|sidebar|side-bar|comments?|commentlist|disqus|respond|cookies?|consent|gdpr"
    r"|notice|alert|popup|modal|newsletter|subscribe|subscription|share|sharing|social|related|recommended|breadcrumbs?|nav|navbar|navigation|menu"
    r"|header|masthead|footer|copyright|pagination|pager|toolbar|widget|skip-link|login|signup|search)(?![a-z])"
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_MARKS = re.compile(r"(?:^|\s)(?:class|id|role|data-role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: What only names a part that is near or missing, and the heads of articles.
_NO_MARK = re.compile(r"(?<![a-z])(?:with|without|has|no)[-_][^\s]*|(?<![a-z])(?:article|entry|post|story)[-_]+header(?![a-z])")
_COMMENTS = re.compile(r"(?<![a-z])(comments?|commentlist|disqus|respond)(?![a-z])")
_SPACE = re.compile(r"\s+")
_LISTS = ("ul", "ol", "dl", "table", "select", "menu")

WINDOW = 3
#: Characters that a window must hold, at most, for the text to surge, and the share of an average window that is enough.
SURGE = 60
SHARE_OF_MEAN = 0.25
#: Marks that also stand in names of what a text is about: such a part is none if its lines hold SURGE characters each.
_WEAK = re.compile(r"share|sharing|social|search")
#: An <article> of less than this share of the largest one's text is a teaser.
TEASER = 0.25


class Part:
    """An element that is marked as a side part, or an <article> or <main>, and what it holds."""

    def __init__(self, name: str, outer: Part | None, comments: bool = False, weak: bool = False) -> None:
        self.name, self.outer, self.comments, self.weak, self.lines = name, outer, comments, weak, 0
        self.article = self.main = False  # whether it holds one
        self.closed = self.begun = False
        self.plain = 0


class Line:
    """A line: its text, the characters outside links, whether the names of its elements strip it, the innermost
    marked element and the innermost <article> and <main> around it, whether it is a heading, and whether it is in a
    list or table."""

    __slots__ = ("text", "plain", "aside", "mark", "article", "main", "heading", "item")

    def __init__(self, text: str, plain: int, aside: bool, mark: Part | None, article: Part | None, main: Part | None, heading: bool, item: bool) -> None:
        self.text, self.plain, self.aside, self.mark, self.article, self.main, self.heading, self.item = text, plain, aside, mark, article, main, heading, item


class _Stack:
    """The open elements, with the places of each name: closing looks nothing up by walking."""

    def __init__(self) -> None:
        self.items: list[tuple[str, bool, Part | None, Part | None]] = []  # element, whether its name strips it, it as a marked part, as an article
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, aside: bool, part: Part | None, hint: Part | None) -> None:
        self.places.setdefault(name, []).append(len(self.items))
        if name in BLOCK:
            self.blocks.append(len(self.items))
        self.items.append((name, aside, part, hint))

    def pop(self) -> tuple[str, bool, Part | None, Part | None]:
        item = self.items.pop()
        self.places[item[0]].pop()
        if item[0] in BLOCK:
            self.blocks.pop()
        return item

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def has(self, name: str) -> bool:
        return bool(self.places.get(name))


def _side_parts(marks: list[Part], lines: list[Line]) -> set[Part]:
    """The marked elements that are side parts, or lie in one. No mark holds around <main>, or most of the page's text
    (of comments: nearly all), unless an article beside it is more than a teaser. Marks around an <article> are lifted from the outside
    in, until one stands free: an <article> in the comments or a list of related ones is a side part beside it."""
    total = 0
    for x in lines:
        if not x.aside:
            total += x.plain
            if x.mark:
                x.mark.plain += x.plain
                x.mark.lines += 1
    for m in reversed(marks):  # inner ones stand after their outer ones
        if m.outer:
            m.outer.plain += m.plain
            m.outer.lines += m.lines
    beside = sum(x.plain for x in lines if x.article and not x.aside and not x.mark)
    lifted = {m for m in marks if m.main or m.plain >= SURGE and 2 * m.plain > total and beside < TEASER * m.plain and (not m.comments or total - m.plain < SURGE and not beside)}
    lifted |= {m for m in marks if m.weak and m.lines and m.plain >= SURGE * m.lines}
    around: dict[Part | None, int] = {None: 0}  # marks that hold, around an article
    inside: set[Part | None] = set()  # those in a side part without an article
    for m in marks:
        around[m] = around[m.outer] + (m.article and m not in lifted)
        if m.outer in inside or not m.article and m not in lifted:
            inside.add(m)
    free = min((around[x.mark] for x in lines if x.article and not x.aside and x.mark not in inside), default=0)
    lifted |= {m for m in marks if m.article and around[m] <= free}
    out: set[Part] = set()
    for m in marks:
        if m not in lifted or m.outer in out:
            out.add(m)
    return out


def parsed(page: str) -> tuple[list[Line], list[Part]]:
    """The lines of a page and its marked elements, in one pass over it."""
    lines: list[Line] = []
    stack, marks = _Stack(), []
    asides = links = 0
    mark: Part | None = None
    hints: dict[str, Part | None] = {"article": None, "main": None}
    parts: list[str] = []
    plain = 0

    def end_line() -> None:
        nonlocal parts, plain
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            lines.append(Line(text, min(plain, len(text)), asides > 0, mark, hints["article"], hints["main"], bool(stack.blocks) and stack.items[stack.blocks[-1]][0] in HEADINGS, stack.has("li") or stack.has("td")))
        parts, plain = [], 0

    def pop(closed: bool = False) -> None:
        nonlocal asides, links, mark
        name, aside, part, hint = stack.pop()
        asides -= aside
        links -= name == "a"
        if part is not None:
            part.closed = closed or name in CLOSES_SELF or name == "p"
            mark = part.outer
        if hint is not None:
            hints[name] = hint.outer

    def close_to(place: int) -> None:
        while len(stack.items) > place + 1:
            pop()
        pop(True)

    def add(raw: str) -> None:
        nonlocal plain
        if raw:
            text = unescape(raw)
            parts.append(text)
            if not links:
                plain += len(_SPACE.sub("", text))

    at, lower = 0, None
    while (m := _TOKEN.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{name}", at) if len(lower) == len(page) else next((x.start() for x in re.compile(f"</{name}", re.I).finditer(page, at)), -1)
                at = len(page) if end < 0 else end
            continue
        if name in BLOCK:
            end_line()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            if stack.has(name):
                close_to(stack.last(name))
            continue
        if name in BLOCK and stack.blocks and stack.items[stack.blocks[-1]][0] == "p":  # a block ends a paragraph, with what is open in it
            close_to(stack.blocks[-1])
        if name in CLOSES_SELF:
            same = max(stack.last(x) for x in CLOSES_SELF[name].split())
            if same > max(stack.last(x) for x in _LISTS):
                close_to(same)
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCK and name != "a":
            continue
        part = hint = None
        aside = name in ASIDE and not (name == "header" and (hints["article"] or hints["main"]))
        if name in MAIN:
            around = mark
            while around and not getattr(around, name):  # further out all are told
                setattr(around, name, True)
                around = around.outer
            hints[name] = hint = Part(name, hints[name])
        if m[3] and name not in ("html", "body", "main") and (words := " ".join(x or y or z for x, y, z in _MARKS.findall(m[3])).lower()):
            if (found := MARKED_ASIDE.search(_NO_MARK.sub(" ", words))) is not None:
                mark = part = Part(name, mark, bool(_COMMENTS.fullmatch(found[0])), bool(_WEAK.fullmatch(found[0])))
                marks.append(part)
        stack.push(name, aside, part, hint)
        asides += aside
        links += name == "a"
    add(page[at:])
    end_line()
    return lines, marks


def weights(lines: list[Line], marks: list[Part]) -> tuple[list[tuple[Line, int]], bool]:
    """The lines that can be text, with their weights, those of side parts left out; and whether they are those of a
    marked article."""
    for x in lines:  # a marked part that is never closed is its first line
        first = x.mark
        if first is not None and not (first.closed or first.begun or first.article or first.main):
            while first is not None and not first.begun:
                first.begun, first = True, first.outer
        else:
            path = []
            while x.mark is not None and not x.mark.closed:
                path.append(x.mark)
                x.mark = x.mark.outer
            for m in path:  # each way is walked once
                m.outer = x.mark
    side = _side_parts(marks, lines)
    rest = [x for x in lines if not x.aside and x.mark not in side]
    total = sum(x.plain for x in rest)
    articles: dict[Part, int] = {}
    for x in rest:
        if x.article:
            top = x.article
            articles[top] = articles.get(top, 0) + x.plain
    largest = max(articles.values(), default=0)
    teasers = {a for a, n in articles.items() if n < TEASER * largest}
    hinted = sum(x.plain for x in rest if x.main or x.article and x.article not in teasers)
    if 2 * hinted <= total or not hinted:  # no article that holds most of the text
        small = {a for a, n in articles.items() if n < TEASER * (total - hinted)}
        return [(x, 0 if x.article in small else x.plain) for x in rest], False
    around = {a.outer for a in articles if a.outer}  # an article around others is none of several
    inside = [x for x in rest if x.main or x.article]
    return [(x, 0 if x.article in teasers and x.article not in around else x.plain or int(not x.item)) for x in inside], True


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page, its blocks joined by line feeds; empty for null, or if there is none. Linear in the page.

    Headings right before a surge belong to it. Of equal stretches all are kept; a stretch goes on over less than a
    window of lines that weigh nothing."""
    lines, marked = weights(*parsed(page)) if page else ([], False)
    weighed = np.array([w for _, w in lines], np.int64)
    if not weighed.any():
        return ""
    surge = 1 if marked else min(surge, max(1, int(SHARE_OF_MEAN * window * weighed[weighed > 0].mean())))
    sums = np.convolve(weighed, np.ones(window, np.int64))[: len(weighed)]  # of each line and those just before it
    stretches, begin, last, after = [], None, 0, 0
    for k in range(len(lines) + 1):
        if k < len(lines) and begin is None and weighed[k] and sums[min(k + window - 1, len(lines) - 1)] >= surge:
            begin = k
            while begin > after and weighed[begin - 1] and lines[begin - 1][0].heading:
                begin -= 1
        elif begin is not None and (k == len(lines) or not sums[k]):
            stretches.append((begin, last + 1))
            begin, after = None, last + 1
        if k < len(lines) and weighed[k]:
            last = k
    return "\n".join(lines[k][0].text for a, b in stretches or [(0, len(lines))] for k in range(a, b))


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of pages (page_id, url, html; other columns
    are ignored). Null or empty html: empty text. Repeated rows stay; no rows give no rows. One narrow pass, nothing is
    shuffled; a page of any length is read whole, in linear time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, window, surge) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
