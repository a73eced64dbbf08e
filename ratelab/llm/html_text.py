"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SIGMA = 2.0  # of the Gaussian, in lines
APART = 3.0  # times that the mean ratio of content is over that of other lines, at least

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
_NOT_TEXT = set(
    "aside audio button canvas dialog embed fieldset footer form head header iframe input label legend map math menu nav "
    "noscript object option script search select style svg template textarea title video".split()
)
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_REGIONS = ("main", "article")
_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
# Words of a class or id that name page furniture, or only say what stands beside the content.
_FURNITURE = re.compile(
    r"(?<![^\s_-])(ads?|adverts?|advertisements?|advertising|banners?|breadcrumbs?|comments?|consent|cookies?|discussion|"
    r"disqus|footer|footnav|header|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|notifications?|popup|"
    r"promos?|promoted|recommended|related|repl(?:y|ies)|respond|shar(?:e|ing)|side-?bars?|signup|skip|social|sponsor(?:ed)?s?|"
    r"subscribe|subscription|toolbar|widgets?)(?![^\s_-])",
    re.I,
)
_COMMENT = re.compile(r"(?<!\S)(?:div-)?(?:comment|reply)(?:[_-](?:body|content|item|\d+))?(?!\S)", re.I)
# Whole names that can only be what readers wrote.
_READERS = re.compile(
    r"(?:(?:user|reader|visitor|post|article|blog|page|entry|fb|disqus)[_-])?(?:comments?|repl(?:y|ies))"
    r"(?:[_-](?:list|section|area|wrap|wrapper|threads?|container|block|box|feed))?",
    re.I,
)
# Inline elements without text of the page: blocks inside them end nothing outside.
_HOLDERS = _NOT_TEXT - _BLOCK - {"label", "map"}
_CLOSED_BY = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


class Lines(HTMLParser):
    """Blocks of a page in order: pieces of text, number of tags, region.

    A piece knows the innermost element around it whose class or id names
    furniture (its place in ``suspects``, or -1). Whether such an element is
    furniture is open until the page is read.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Pieces, tags, region and whether the line is a heading.
        self.lines: list[tuple[list[tuple[str, int]], int, int, bool]] = []
        # Per suspect: the one around it, characters, tags, whether a region is inside, and whether a
        # whole name is furniture (1) or what readers wrote (2).
        self.suspects: list[list[int]] = []
        self._text: list[tuple[str, int]] = []
        self._region, self._heading = 0, False  # of the stored text
        self._tags = 0
        self._all_tags = self.all_chars = 0
        # Open elements: (tag, without text of the page, region, suspect, suspect outside the region's header or None)
        self._open: list[tuple[str, bool, int, int, int | None]] = [("", False, 0, -1, None)]
        self.regions = 0
        # Places of open blocks and holders, and how often each inline tag is open inside the innermost one.
        self._walls = [0]
        self._inline: list[dict[str, int]] = [{}]
        self._count: dict[str, int] = {}

    def parse_html_declaration(self, i: int) -> int:
        # A declaration that is none is a comment; the parser would raise on some.
        if self.rawdata.startswith("<![", i) and not self.rawdata.startswith("<![CDATA[", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def _push(self, element: tuple[str, bool, int, int, int | None]) -> None:
        tag = element[0]
        if tag in _BLOCK or tag in _HOLDERS:
            self._walls.append(len(self._open))
            self._inline.append({})
        else:
            self._inline[-1][tag] = self._inline[-1].get(tag, 0) + 1
        self._count[tag] = self._count.get(tag, 0) + 1
        self._open.append(element)

    def _flush(self) -> None:
        if self._text:
            if any(text and not text.isspace() for text, _ in self._text):
                self.lines.append((self._text, self._tags, self._region, self._heading))
                self._tags = 0
            self._text = []

    def _pop(self, at: int) -> None:
        for i in range(at, len(self._open)):
            own = self._open[i][3]
            # A heading leaves the suspect of its header; only the element that opened a suspect ends it.
            if own > self._open[i - 1][3]:
                _, chars, tags, *_ = self.suspects[own]
                self.suspects[own][1:3] = self.all_chars - chars, self._all_tags - tags
        while len(self._open) > at:
            tag = self._open.pop()[0]
            self._count[tag] -= 1
            if self._walls[-1] == len(self._open):
                self._walls.pop()
                self._inline.pop()
            else:
                self._inline[-1][tag] -= 1

    def _tag(self) -> None:
        self._tags += 1
        self._all_tags += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            if tag in ("br", "hr", "wbr", "img", "input"):
                self._text.append(("" if tag == "wbr" else " ", -1))
            if tag == "hr" and not self._open[-1][1]:
                self._flush()
            self._tag()
            return
        if tag in _BLOCK:
            # What is stored was visible; a block that is not cannot end it.
            if not self._open[-1][1]:
                self._flush()
            self._close_implied(tag)
            if not self._open[-1][1]:
                self._flush()
        if tag == "body":
            self._tags = 0  # tags of the head say nothing about the first line
        _, hidden, region, suspect, head = self._open[-1]
        if head is not None and tag in _HEADINGS:
            # An article's own headings stay.
            self._flush()
            hidden, suspect = False, head
        elif not hidden:
            hidden = tag in _NOT_TEXT
            if hidden and tag == "header" and region:
                head = suspect
            names = ""
            if not hidden and attrs and tag not in ("html", "body"):
                for name, value in attrs:
                    if name == "hidden" or name == "aria-hidden" and value == "true" or value and name == "role" and value.lower() in _ROLES:
                        hidden = True
                    elif value and name in ("class", "id"):
                        names += " " + value
            if not hidden and tag in _REGIONS:
                hidden = tag == "article" and _COMMENT.search(names) is not None
                if not hidden:
                    around = suspect
                    while around >= 0 and not self.suspects[around][3]:
                        self.suspects[around][3] = 1
                        around = self.suspects[around][0]
                    if not region:
                        self.regions += 1
                        region = self.regions
            elif not hidden and names:
                words = _FURNITURE.findall(names)
                if words:
                    only_head = region and all(w.lower() in ("header", "masthead") for w in words)
                    head = suspect if only_head else None
                    # "ad" and "cookie-notice" name the element, "has-sidebar" and "comments-open" may name what is beside it.
                    plain = any(all(map(_FURNITURE.fullmatch, filter(None, re.split("[_-]", n)))) for n in names.split())
                    readers = any(map(_READERS.fullmatch, names.split()))
                    self.suspects.append([suspect, self.all_chars, self._all_tags, 0, 2 if readers else int(plain)])
                    suspect = len(self.suspects) - 1
        self._tag()
        self._push((tag, hidden, region, suspect, head))

    def _close_implied(self, tag: str) -> None:
        # Only the innermost block can end so.
        i = self._walls[-1]
        name = self._open[i][0]
        if i and tag in _CLOSED_BY.get(name, ()):
            self._pop(i)

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            return
        self._tag()
        wall = tag in _BLOCK or tag in _HOLDERS
        # An inline end tag does not close the block around it.
        if not (self._count if wall else self._inline[-1]).get(tag):
            if tag in _BLOCK and not self._open[-1][1]:
                self._flush()
            return
        # What is passed over here is closed: no element is passed twice.
        i = len(self._open) - 1
        while self._open[i][0] != tag:
            i -= 1
        if tag in _BLOCK and not (self._open[i][1] and self._open[i - 1][1]):
            self._flush()
        self._pop(i)

    def handle_data(self, data: str) -> None:
        _, hidden, region, suspect, _ = self._open[-1]
        if not hidden:
            self._text.append((data, suspect))
            self._region, self._heading = region, self._open[self._walls[-1]][0] in _HEADINGS
            self.all_chars += len(data.strip())

    def close(self) -> None:
        super().close()
        self._flush()
        self._pop(1)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; weights outside the page are left out."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def main_text(html: str | None) -> str:
    """Blocks of the main text, joined by an empty line; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = _lines(parser, set())
    if not lines:
        return ""
    if parser.suspects:
        # A class or id hides what has few characters per tag on this page, and never an article. A whole
        # name also hides what has more, where an article is marked elsewhere or most text is elsewhere.
        ratios, even = _ratios(lines)
        low = _least(ratios, even)
        furniture: set[int] = set()
        for i, (around, chars, tags, region, plain) in enumerate(parser.suspects):
            beside = plain and (parser.regions or 2 * chars <= parser.all_chars or plain == 2 and chars < parser.all_chars)
            if around in furniture or not region and (chars / max(1, tags) < low or beside):
                furniture.add(i)
        lines = _lines(parser, furniture) if furniture else lines
        if not lines:
            return ""
    ratios, even = _ratios(lines)
    # Two clusters of lines by smoothed ratio. Smoothing may lift a line's neighbours over the line
    # itself, so its own ratio counts too, and the longest line is always content.
    least = _split(even)
    content = (even >= least) | (ratios >= max(least, _split(ratios)))
    content[int(np.argmax([len(x[0]) for x in lines]))] = True
    sizes: dict[int, int] = {}
    for (text, _, region, _), good in zip(lines, content):
        if good:
            sizes[region] = sizes.get(region, 0) + len(text)
    inside = {r: n for r, n in sizes.items() if r}
    if inside and 2 * sum(inside.values()) > sum(sizes.values()):
        # The page marks its articles, and most of the content is there: all of
        # each, but for cards that are far smaller than the largest.
        whole = {r for r, n in inside.items() if 4 * n >= max(inside.values())}
        kept = [x[0] for x in lines if x[2] in whole]
    else:
        kept = [x[0] for x in lines[slice(*_span(lines, content))]]
    return "\n\n".join(kept)


def _split(values: np.ndarray) -> float:
    """Between the means of two clusters; the least value if the clusters are not far apart."""
    order = np.sort(values)
    if len(order) < 2:
        return float(order[0])
    count = np.arange(1, len(order))
    below = np.cumsum(order)[:-1]
    low, high = below / count, (order.sum() - below) / (len(order) - count)
    best = int(np.argmax(count * (len(order) - count) * (high - low) ** 2))
    return float((low[best] + high[best]) / 2) if high[best] > APART * low[best] else float(order[0])


def _span(lines: list[tuple[str, int, int, bool]], content: np.ndarray) -> tuple[int, int]:
    """From the first to the last line of the content, and the headings just before it."""
    at = np.flatnonzero(content)
    first = int(at[0])
    while first and lines[first - 1][3]:
        first -= 1
    return first, int(at[-1]) + 1


def _lines(parser: Lines, furniture: set[int]) -> list[tuple[str, int, int, bool]]:
    """Text, tags, region and heading of each line without the pieces in ``furniture``; tags of empty lines count for the next."""
    out = []
    before = 0
    for pieces, tags, region, heading in parser.lines:
        text = " ".join("".join([t for t, s in pieces if s not in furniture]).split())
        if text:
            out.append((text, before + tags, region, heading))
            before = 0
        else:
            before += tags
    return out


def _ratios(lines: list[tuple[str, int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    ratios = np.array([len(text) / max(1, tags) for text, tags, *_ in lines])
    return ratios, smooth(ratios)


def _least(ratios: np.ndarray, even: np.ndarray) -> float:
    return min(ratios.std(), even.max())


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Null, empty and tag-only pages have empty text. Rows are independent of
    each other: repeated ones give the same text, an empty table gives an
    empty result, other columns are not read. Any markup is read, however
    broken; time is linear in a page, and memory is bounded by a batch of
    pages.
    """

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in pages], dtype=object)

    found = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), texts(F.col(html).cast("string")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
