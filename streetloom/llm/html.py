"""HTML extraction: streaming parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser feeds events, in pieces, to a builder of lines: the start or end of a block element ends
a line, a line break is a space. A line keeps its text, the tags seen in it, the characters inside links, the containers
around it and the marked article it stands in, if any. Elements that hold no running text of a page by their own name or
role (navigation, page header and footer, sidebars, forms, scripts, styles), that are hidden, or whose class or id is
made of names of such parts, give no lines.

Which of the lines are the article is decided by their numbers, on every page: a line's ratio is its characters outside
links for each tag; lines in an element that the page marks as its article (article, main, role=main,
itemprop=articleBody) have their ratio raised MARK times. Ratios are smoothed by a Gaussian along the page. Lines that
reach THRESHOLD of the mean smoothed ratio form clusters, runs within one article or outside all; clusters with a SHARE
of the largest one's sum are content. A cluster stands for a region: the least container around its lines, or the marked
article they are in. All lines of the region but those made of links are the text, so an article's short headings, lists
and last lines stay.

Defined results: null and empty html give the empty text. Unclosed and truncated markup is read as far as it goes; an
unfinished tag at the end is dropped, an unfinished character reference stays as written. Very long pages are fed in
pieces. Repeated pages get equal rows. Columns of pages named text or n_chars are replaced, others stay.
"""

from __future__ import annotations

import html as references
import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns

SIGMA = 1.0
#: A line opens a cluster where its smoothed ratio reaches this share of the page's mean; what a mark of the page's own
#: is worth; the least sum of a cluster, as a share of the largest one's; share of link characters of a line of links.
THRESHOLD, MARK, SHARE, LINKS = 0.5, 20.0, 0.2, 0.5
FEED = 1 << 16

SKIPPED = frozenset("script style noscript template svg math head title nav footer aside form button select textarea option label iframe object canvas dialog menu audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
RAW = frozenset(("script", "style"))
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: A class or id is noise if all its parts between hyphens are of these two lists and one at least is of the first.
NOISE = frozenset("ad ads advert advertisement adsense sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer topbar toolbar cookie cookies consent notice gdpr popup modal newsletter subscribe signup login social share sharing related comment comments commentlist respond disqus replies pagination pager copyright alert".split())
NEUTRAL = frozenset("area banner bar block bottom box buttons container content footer form group header icons inner item left links list main outer page panel posts primary right row secondary section site slot text top unit widget wrap wrapper".split())
#: Noise only outside a marked article, which may have a header of its own.
OUTSIDE = frozenset("header masthead banner".split())
_PART = re.compile(r"[-_]+")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_SPACE = re.compile(r"\s+")


CONTAINERS = frozenset("body article main section div td center blockquote".split())


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    #: Number of the marked article, 0 outside all; numbers of the containers around the line, the outermost first.
    region: int
    path: tuple[int, ...]


def named_noise(value: str, inside: bool) -> bool:
    """Whether a class or id names a part of a page that is no article."""
    for name in value.lower().split():
        parts = [p for p in _PART.split(name) if p]
        if all(p in NOISE or p in NEUTRAL for p in parts) and any(p in NOISE or not inside and p in OUTSIDE for p in parts):
            return True
    return False


class Lines(HTMLParser):
    """Events to lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, whether it drops its text, the region before it, number of the container or 0.
        self.stack: list[tuple[str, bool, int, int]] = []
        self.dropped = 0
        self.inside = 0
        self.regions = self.containers = 0
        self.path: tuple[int, ...] = ()
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0
        self.lines: list[Line] = []

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.inside, self.path))
            self.tags = 0
        self.text, self.linked = [], 0

    def noise(self, tag: str, attrs: list) -> bool:
        if tag in SKIPPED:
            return True
        if tag == "header":
            return not self.inside
        if not attrs or tag in ("html", "body", "article", "main"):
            return False
        for k, v in attrs:
            if v and (k in ("class", "id") and named_noise(v, bool(self.inside)) or k == "role" and v.lower() in _ROLES):
                return True
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
                return True
        return False

    def marks(self, tag: str, attrs: list) -> bool:
        return tag in ("article", "main") or any(k == "role" and v == "main" or k == "itemprop" and v == "articleBody" for k, v in attrs)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if not self.dropped:
            self.tags += 1
            if tag in BLOCK:
                if tag in CLOSES_P:
                    self.close_p()
                self.end_line()
            elif tag == "br":
                self.text.append(" ")
        if tag in VOID:
            return
        drops = self.noise(tag, attrs) or bool(self.dropped and tag == "article" and self.inside)
        before = self.inside
        if not self.dropped and not drops and not self.inside and self.marks(tag, attrs):
            self.regions += 1
            self.inside = self.regions
        elif not self.dropped and self.inside and tag == "article" and any(t == "article" for t, *_ in self.stack):
            drops = True  # an article inside an article is a comment or a teaser
        held = 0
        if tag in CONTAINERS:
            self.containers += 1
            held = self.containers
            self.path += (held,)
        self.stack.append((tag, drops, before, held))
        self.dropped += drops
        self.links += tag == "a"

    def close_p(self) -> None:
        """An open paragraph ends where a block begins; a stray one deeper than a block is left."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == "p":
                self.cut(k)
                return
            if self.stack[k][0] in BLOCK:
                return

    def cut(self, k: int) -> None:
        for tag, drops, before, held in reversed(self.stack[k:]):
            self.dropped -= drops
            if held:
                self.path = self.path[:-1]
            self.links -= tag == "a"
            if not drops:
                self.inside = before
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK and not self.dropped:
            self.tags += 1
            self.end_line()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                # An inner end tag does not close a container that must be ended by its own.
                if tag not in BLOCK and any(t in BLOCK for t, *_ in self.stack[k + 1 :]):
                    return
                self.cut(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def lines_of(page: str) -> list[Line]:
    parser = Lines()
    for at in range(0, len(page), FEED):
        parser.feed(page[at : at + FEED])
    rest = parser.rawdata
    if rest and "<" not in rest[:1] and parser.cdata_elem is None:
        parser.rawdata = ""
        parser.handle_data(references.unescape(rest))
    parser.end_line()
    return parser.lines


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters outside links for each tag of the line, raised inside a marked article."""
    return np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) * (MARK if x.region else 1.0) for x in lines])


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel, "full")[reach : reach + len(x)]
    return np.convolve(x, kernel, "full")[reach : reach + len(x)] / weight


def clusters(lines: list[Line]) -> list[tuple[int, int, float]]:
    """(first, after last, sum of smoothed ratios) of the runs of lines that open."""
    score = smoothed(ratios(lines))
    opens = score >= THRESHOLD * score.mean()
    found, first = [], None
    for k in range(len(lines) + 1):
        if first is not None and (k == len(lines) or not opens[k] or lines[k].region != lines[first].region):
            found.append((first, k, float(score[first:k].sum())))
            first = None
        if first is None and k < len(lines) and opens[k]:
            first = k
    return found


def content(lines: list[Line]) -> list[str]:
    """The lines of the content regions, in page order."""
    if not lines:
        return []
    linky = [x.linked > LINKS * len(x.text) for x in lines]
    found = clusters(lines)
    least = SHARE * max(c[2] for c in found)
    articles, containers = set(), set()
    for first, last, total in found:
        held = [k for k in range(first, last) if not linky[k]]
        if total < least or not held:
            continue
        if lines[first].region:
            articles.add(lines[first].region)
            continue
        # The containers that all lines of the cluster share; the innermost one is the region.
        path = lines[held[0]].path
        for k in held:
            path = path[: next((d for d, (a, b) in enumerate(zip(path, lines[k].path, strict=False)) if a != b), min(len(path), len(lines[k].path)))]
        containers.add(path[-1] if path else 0)
    kept = lambda x: x.region in articles if x.region else bool(containers.intersection(x.path or (0,)))
    # A marked article keeps its lists of links; elsewhere a line of links is a menu.
    return [x.text for x, menu in zip(lines, linky, strict=True) if kept(x) and (x.region or not menu)]


def extract(page: str | None) -> str:
    return "\n".join(content(lines_of(page))) if page else ""


def extract_text(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars."""

    def make(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(html_col).to_pylist()]
            yield [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return add_columns(pages, "text string, n_chars long", make)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
