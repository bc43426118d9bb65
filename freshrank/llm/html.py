"""The main text of web pages: parser events, text-to-tag ratios of lines, smoothing, and a threshold that picks the region."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Width of the Gaussian in lines; standard deviations of the smoothed ratios from which a line is content.
SIGMA, THRESHOLD = 1.0, 0.5
OUT = "page_id long, url string, text string, n_chars long"

#: Elements that begin and end lines, and those of them that hold others.
BOXES = {"html", "body", "main", "article", "section", "div", "center", "header", "footer", "aside", "nav", "form", "fieldset", "hgroup"}
BLOCKS = BOXES | {"address", "blockquote", "caption", "dd", "details", "dialog", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "legend", "li",
                  "menu", "ol", "option", "p", "pre", "search", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: White space, not the end of a line.
BREAKS = {"br", "td", "th"}
#: Never text of an article, whatever they hold.
NEVER = {"aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "input", "menu", "nav", "noscript", "object", "script", "search", "select",
         "style", "svg", "template", "textarea", "title", "video"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "status", "toolbar"}
#: Words in names of classes and ids that say the same; of HEADS only where the name does not speak of the article.
NAMES = {"ad", "ads", "advert", "advertisement", "adverts", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
         "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies",
         "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets"}
HEADS = {"header", "masthead", "topbar"}
OWN = {"article", "entry", "post", "content", "story", "page", "no", "has", "with", "without"}
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _by_name(attrs: dict, article: bool) -> bool:
    """Whether an element's class or id says that it is no part of an article; of an article element, that it is a comment."""
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = {p.lower() for p in _PART.findall(name)}
        if article:
            if parts and parts <= {"comment", "comments", "reply"}:
                return True
        elif parts & NAMES and not parts & {"no", "has", "with", "without"} or parts & HEADS and not parts & OWN:
            return True
    return False


class Element:
    """An open element: its tag and number; whether it is out of the article, and whether its text is no line's at all; what is around it."""

    __slots__ = ("tag", "number", "out", "mute")

    def __init__(self, tag: str, number: int, out: bool, mute: bool):
        self.tag, self.number, self.out, self.mute = tag, number, out, mute


class Lines(HTMLParser):
    """A page's lines as its parser's events come: texts, tags and characters within links of each, the element it stands in, and whether it is out of the article.

    Elements are numbered; of each there are its tag, the element around it, the outermost article and main around it (None: there is none) and the lines it holds, from the first to before the last.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.article, self.main, self.first, self.last = ["#page"], [-1], [None], [None], [0], [0]
        self.stack = [Element("#page", 0, False, False)]
        self.open: Counter = Counter()
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                top = self.stack[-1]
                self.lines.append((text, self.tags, self.linked, top.number, top.out))
                self.tags = 0
            self.parts, self.linked = [], 0

    def pop(self) -> None:
        gone = self.stack.pop()
        self.open[gone.tag] -= 1
        self.last[gone.number] = len(self.lines)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        top = self.stack[-1]
        block = tag in BLOCKS
        if block:
            self.flush()
            for depth in range(len(self.stack) - 1, 0, -1):
                held = self.stack[depth].tag
                if held in ENDS and tag in ENDS[held]:
                    while len(self.stack) > depth:
                        self.pop()
                    top = self.stack[-1]
                    break
                if held in BLOCKS:
                    break
        self.tags += 1
        if tag in BREAKS:
            self.parts.append(" ")
        if tag in VOID:
            return
        number, article, main = len(self.tag), self.article[top.number], self.main[top.number]
        out = top.out or tag in NEVER or tag == "header" and article is None or tag == "article" and article is not None  # articles in an article are comments on it
        if attrs and not out and tag not in ("html", "body", "main"):
            named = dict(attrs)
            out = named.get("role") in ROLES or "hidden" in named or _by_name(named, tag == "article")
        self.tag.append(tag)
        self.parent.append(top.number)
        self.article.append(number if article is None and tag == "article" else article)
        self.main.append(number if main is None and tag == "main" else main)
        self.first.append(len(self.lines))
        self.last.append(-1)
        self.stack.append(Element(tag, number, out, top.mute or out and not block))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close what is not void

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in BREAKS:
            self.parts.append(" ")
        if not self.open[tag]:
            return
        while self.stack[-1].tag != tag:
            if tag not in BLOCKS and self.stack[-1].tag in BLOCKS:
                return  # a phrase's end does not close the block around it
            self.pop()
        self.pop()

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].mute:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def read(self, html: str) -> Lines:
        cut = html.rfind("<")
        if cut > html.rfind(">") and re.match(r"<[A-Za-z/!?]", html[cut:cut + 2]):
            html = html[:cut]  # the page ends within a tag
        self.feed(html.replace("<![", "<?["))
        self.close()
        self.flush()
        while self.stack:
            self.pop()
        return self


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """ratios under a Gaussian window; beyond the ends there is nothing."""
    reach = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, weights / weights.sum())[reach:reach + len(ratios)]


def main_text(html: str, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The article's blocks, one a line.

    A line is a block's text; its ratio, its characters for each tag since the last. Ratios are smoothed, and lines of a threshold and more are content.
    Lines that menus, headers, footers, asides, forms, adverts, notices, comments and the like hold (by elements, roles, and words in classes and ids) are out.
    Content lines in a row, what is out not counted, are a region; one in an article element goes before others, then the longest. The article is what the region's lines have
    in common: the article or main element around them, or else the smallest box that holds them all, and boxes around it that add nothing but headings and content. All its lines belong
    to it, short ones too; outside article elements, lines of links below the threshold do not.
    """
    page = Lines().read(html)
    lines = page.lines
    kept = [i for i, x in enumerate(lines) if not x[4]]
    if not kept:
        return ""
    raw = np.array([len(x[0]) / max(1, x[1]) for x in lines])
    ratio = smoothed(raw, sigma)
    level = min(threshold * ratio.std(), ratio[kept].max())
    links = np.array([x[2] >= 0.6 * len(x[0]) for x in lines])
    own = [page.article[x[3]] for x in lines]
    content = (ratio >= level) & ~(links & (raw < level))
    regions: list[list[int]] = [[]]
    for i in kept:
        if content[i]:
            regions[-1].append(i)
        elif regions[-1]:
            regions.append([])
    if not regions[0]:
        regions = [kept]  # nothing but links
    best = max(regions, key=lambda r: (any(own[i] is not None for i in r), sum(len(lines[i][0]) for i in r)))
    articles = {own[i] for i in best} - {None}
    if articles:
        return "\n".join(lines[i][0] for i in kept if own[i] in articles)
    box = lines[best[0]][3]
    while page.tag[box] not in BOXES and box or page.last[box] <= best[-1] or page.first[box] > best[0]:
        box = page.parent[box]
    if page.main[box] is not None:
        box = page.main[box]
    first, last = page.first[box], page.last[box]
    while (outer := page.parent[box]) >= 0 and page.tag[box] != "main":
        more = [i for i in (*range(page.first[outer], first), *range(last, page.last[outer])) if not lines[i][4]]
        if any(not content[i] and page.tag[lines[i][3]] not in ("h1", "h2") for i in more):
            break
        box, first, last = outer, page.first[outer], page.last[outer]
    return "\n".join(lines[i][0] for i in range(first, last) if not lines[i][4] and not (links[i] and raw[i] < level))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars (code points): one row for each, in the task that reads it; nothing moves.

    Null and empty pages, and such without an article, have an empty text. White space is what Unicode calls so, non-breaking spaces too; a br is white space, as is a table's cell's end.
    Repeated rows come as often as they are there; an empty table gives no rows; other columns are left out.
    """

    def run(batches):
        for batch in batches:
            found = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, OUT)
