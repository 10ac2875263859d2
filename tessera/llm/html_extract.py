"""HTML extraction: parser events to lines, text-to-tag ratio, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; block-level tags end a line. Elements without shown text (scripts, controls and
the like) are no candidates. Every other line has the ratio of its text to its tags, and lies in a region: an article, a
section, or an element whose tag, role, class or id speaks of menus, notices, adverts, comments and so on, which damps its
ratios. Ratios are smoothed within a region, so that regions don't lend theirs to one another, and lines at or above a
threshold, a share of the ratios' standard deviation, form the content cluster. Regions most of whose text lies in the cluster
are content, with all their lines, so that a short paragraph of an article stays; if some belong to an <article> or <main>,
only those that do.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACES = re.compile(r"\s+")
# fixed values: elements of HTML by their role
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
NEVER = {
    "head", "script", "style", "noscript", "template", "button", "select", "textarea", "input", "iframe", "object", "svg", "canvas", "audio", "video", "title",
}
BESIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|sidebar\w*|side|footer|header|masthead|breadcrumb\w*"
    r"|comment\w*|disqus|respond|replies|reply|cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscri\w*|signup|login"
    r"|share\w*|sharing|social\w*|related|recommend\w*|widget\w*|toolbar|pagination|pager|skip\w*|copyright)(?:$|[-_ ])",
    re.I,
)
SECTIONS = {"article", "main", "section", "div", "td", "body"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}


#: What the ratios of regions are multiplied by whose names speak against them; share of the standard deviation that makes the threshold.
DAMPED = 0.02
SHARE = 0.7


class Lines(HTMLParser):
    """Collects the lines of a page: text, tags, whether a line stands in an article, its region, and the factor of its ratio."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, int, float]] = []  # tag, never shown, in article, region, factor
        self.lines: list[tuple[str, int, bool, int, float]] = []
        self.regions = 0
        self.text: list[str] = []
        self.tags = 0

    def _end_line(self):
        text = SPACES.sub(" ", "".join(self.text)).strip()
        if text:
            _, _, article, region, factor = self._top()
            self.lines.append((text, self.tags, article, region, factor))
            self.tags = 0
        self.text.clear()

    def _top(self) -> tuple[str, bool, bool, int, float]:
        return self.stack[-1] if self.stack else ("", False, False, 0, 1.0)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
        elif tag == "br":
            self.text.append(" ")
        if tag in CLOSES_P:
            # an open paragraph ends, and with it what was left open in it
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    del self.stack[k:]
                    break
                if self.stack[k][0] not in INLINE:
                    break
        if tag in VOID:
            return
        _, never, within, region, factor = self._top()
        article = within or tag in ("article", "main")
        if not never:
            a = {k: v or "" for k, v in attrs}
            never = tag in NEVER or "hidden" in a or a.get("aria-hidden") == "true"
            beside = tag in BESIDE or a.get("role", "").lower() in ROLES or (tag == "article" and within)
            beside = beside or (tag not in ("html", "body", "article", "main") and any(NAMES.search(a.get(k, "")) for k in ("class", "id")))
            if beside or (tag in SECTIONS and not within):  # an article is one region with all within but for these
                self.regions += 1
                region = self.regions
                factor = min(factor, DAMPED) if beside else factor
        self.stack.append((tag, never, article, region, factor))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if not self._top()[1]:
            self.text.append(data)

    def parse_marked_section(self, i, report=1):
        """Skips <![...]> as a whole; the library's own form rejects unknown keywords."""
        j = self.rawdata.find(">", i)
        return j + 1 if j >= 0 else -1

    def close(self):
        super().close()
        self._end_line()


def smoothed(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), mode="valid")


def content_regions(lines: list[tuple[str, int, bool, int, float]], share: float = SHARE) -> set[int]:
    """Regions of lines (text, tags, in article, region, factor) that are content."""
    size = np.array([len(t) for t, *_ in lines], np.float64)
    region = np.array([r for *_, r, _ in lines])
    factor = np.array([f for *_, f in lines])
    ratio = size / np.maximum(1, [n for _, n, *_ in lines]) * factor
    if (factor < 1).all():
        return set()
    for r in np.unique(region):
        ratio[region == r] = smoothed(ratio[region == r])
    inside = ratio >= min(share * ratio.std(), ratio[factor == 1].max())
    held = np.bincount(region, size * inside) * 2 >= np.bincount(region, size)
    content = held[region]
    article = np.array([a for _, _, a, _, _ in lines])
    if (content & article).any():
        content &= article
    return set(region[content].tolist())


def extract(html: str | None) -> str:
    """Main text of a page; '' for null, empty or text-free pages."""
    p = Lines()
    p.feed(html or "")
    p.close()
    if not p.lines:
        return ""
    regions = content_regions(p.lines)
    return "\n".join(t for t, _, _, r, _ in p.lines if r in regions)


def pages_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page from its whole html.

    A null or empty html gives ''. Repeated rows stay; null ids and urls stay null; other columns are not read.
    """

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    src = pages.select("page_id", "url", "html")
    fields = [src.schema["page_id"], src.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return src.mapInArrow(run, T.StructType(fields))
