"""Main text of web pages by tree scoring.

A page becomes a tree of elements (end tags that HTML lets writers leave out are implied)
and a list of blocks: runs of text between block boundaries. Elements that are never
article text are cut off with all they hold: by tag (menus, forms, scripts), by role, by
the words of their class and id (adverts, sidebars, comments), or because they are hidden.
Every remaining block passes points, one plus its commas plus its length, to its ancestors,
halved and then thirded on the way up; a container's points are discounted by the share of
its characters that are link text. The best container is kept, with those siblings that
score near it or read like its text. Blocks of mostly link text inside it go.

One page is one row: nothing is shared between pages, so the operator is one narrow pass.

Defined results: a null or empty page, or one without text outside of cut-off elements, has
empty text; equal points go to the first container in page order; repeated rows give equal
texts; an empty table gives no rows; other columns pass through, and those named like a
result are replaced. A page without any scoring container gives all of its remaining blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# HTML's element names by what they do, and the words of roles and names that mark what isn't article text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul option optgroup".split()
)
CUT_TAGS = set("script style noscript template iframe object embed svg canvas nav footer aside form fieldset button select option textarea input label head title dialog menu noembed noframes search audio video map".split())
CUT_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
CUT_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail footer foot header masthead topbar toolbar"
    " comment comments respond replies disqus discussion notice notices alert warning popup modal overlay lightbox"
    " share sharing social follow related recommended recommendations widget widgets newsletter subscribe subscription signup login"
    " pagination pager pagenav skip tags taglist tagcloud outbrain taboola paywall toast form search".split()
)
CLOSES = {  # a start tag ends the open element of these names, up to the nearest of the holders
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
KEEPERS = {"html", "body", "article", "main"}
START_POINTS = {"article": 25.0, "main": 25.0, "div": 5.0, "section": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0}
GOOD_WORDS = set("article articlebody body content entry hentry main page post story text blog prose".split())

TOKEN = re.compile(
    r"<(?:!--(?P<comment>)|(?P<end>/)(?P<closed>[a-zA-Z][^\s/>]*)[^>]*>|(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<other>[!?/])[^>]*>)"
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ITEMS = {"li", "td", "th", "dd", "dt"}
#: A block of this share of link text is a link.
LINK_SHARE = 0.6
#: An element of an article with a suspicious part in its name is cut off if it has this share
#: of link text, or fewer characters and no heading.
HINT_SHARE, HINT_CHARS = 0.4, 80
#: A list beside the container is prose from so many characters on.
PROSE_LIST = 80


class _Page:
    """Elements in page order (a parent comes before its children) and blocks of text."""

    def __init__(self, html: str):
        self.tag, self.parent, self.cut, self.good = ["#root"], [-1], [False], [False]
        self.named: list[int] = []  # cut off by name only
        self.hinted: list[int] = []  # with such a word as a part of a name only
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._open, self._text, self._links = [0], [], 0
        self._anchors = 0
        self._read(html)

    def _flush(self) -> None:
        if self._text:
            words = " ".join("".join(self._text).split())
            if words:
                self.blocks.append((self._open[-1], words, min(self._links, len(words))))
            self._text, self._links = [], 0

    def _put(self, text: str) -> None:
        text = unescape(text)
        self._text.append(text)
        if self._anchors:
            self._links += len(text.strip())

    def _pop_to(self, depth: int) -> None:
        for number in self._open[depth:]:
            if self.tag[number] == "a":
                self._anchors -= 1
        if any(self.tag[number] in BLOCK for number in self._open[depth:]):
            self._flush()
        del self._open[depth:]

    def _end(self, name: str) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[depth]] == name:
                self._pop_to(depth)
                return

    def _imply_ends(self, name: str) -> None:
        if name in CLOSES:
            ended, holders = CLOSES[name]
            for depth in range(len(self._open) - 1, 0, -1):
                tag = self.tag[self._open[depth]]
                if tag in ended:
                    self._pop_to(depth)
                elif tag in holders:
                    return
        elif name in BLOCK:
            for depth in range(len(self._open) - 1, 0, -1):
                tag = self.tag[self._open[depth]]
                if tag == "p":
                    self._pop_to(depth)
                    return
                if tag in BLOCK:
                    return

    def _start(self, name: str, rest: str) -> None:
        self._imply_ends(name)
        if name in BLOCK:
            self._flush()
        number = len(self.tag)
        words, whole, cut = set(), set(), name in CUT_TAGS
        if rest and not rest.isspace():
            for key, *values in ATTRIBUTE.findall(rest):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id"):
                    whole |= set(value.lower().split())
                    words |= set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
                elif key == "role" and value.lower() in CUT_ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
                    cut = True
        if name == "header" and not any(self.tag[x] in ("article", "main") for x in self._open):
            cut = True
        if not cut and words & CUT_WORDS and name not in KEEPERS and name in BLOCK | {"span", "a"}:
            (self.named if whole & CUT_WORDS else self.hinted).append(number)
        elif not cut and name == "article" and words & {"comment", "comments", "reply"}:
            self.named.append(number)
        self.tag.append(name)
        self.parent.append(self._open[-1])
        self.cut.append(cut)
        self.good.append(bool(words & GOOD_WORDS))
        if name not in VOID:
            self._open.append(number)
            self._anchors += name == "a"
        elif name == "br":
            self._text.append(" ")

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            found = TOKEN.search(html, at)
            if found is None:
                self._put(html[at:])
                break
            if found.start() > at:
                self._put(html[at : found.start()])
            at = found.end()
            if found["comment"] is not None:
                stop = html.find("-->", at)
                at = size if stop < 0 else stop + 3
            elif found["end"]:
                self._end(found["closed"].lower())
            elif found["name"]:
                name, rest = found["name"].lower(), found["rest"]
                self._start(name, rest)
                if name in RAW and not rest.endswith("/"):
                    stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                    at = stop.start() if stop else size
        self._flush()

    def text(self) -> str:
        n = len(self.tag)
        length, linked, headed = [0] * n, [0] * n, [False] * n
        for number, words, links in self.blocks:
            length[number] += len(words)
            linked[number] += links
            headed[number] |= self.tag[number] in HEADINGS
        holds_article = [tag in ("article", "main") for tag in self.tag]
        for number in self.named:  # an article that is a reader's comment holds nothing
            holds_article[number] = False
        for number in range(n - 1, 0, -1):
            length[self.parent[number]] += length[number]
            linked[self.parent[number]] += linked[number]
            headed[self.parent[number]] |= headed[number]
            holds_article[self.parent[number]] |= holds_article[number]
        for number in self.named:  # a name may be misleading where it is on the page's body of text
            self.cut[number] |= not (holds_article[number] or self.good[number] and 2 * length[number] > length[0])
        in_article = [False] * n
        for number in range(1, n):
            up = self.parent[number]
            in_article[number] = in_article[up] or self.tag[up] in ("article", "main") and not self.cut[up]
        for number in self.hinted:  # a part of a name tells little of what stands inside an article
            links = linked[number] > HINT_SHARE * length[number]
            short = length[number] < HINT_CHARS and not headed[number]
            inside = in_article[number] and not links and not short
            self.cut[number] |= not (inside or holds_article[number] or self.good[number] and 2 * length[number] > length[0])
        for number in range(1, n):
            self.cut[number] |= self.cut[self.parent[number]]
        blocks = [b for b in self.blocks if not self.cut[b[0]]]
        chosen = self._chosen(blocks)
        kept = [False] * n
        for number in range(n):
            kept[number] = number in chosen or (number > 0 and kept[self.parent[number]])
        shown = [(number, words, links > LINK_SHARE * len(words)) for number, words, links in blocks if kept[number]]
        # A paragraph that is one link is text; lists of links, and links one after the other, aren't.
        alone = [
            self.tag[number] not in ITEMS and not (i and shown[i - 1][2]) and not (i + 1 < len(shown) and shown[i + 1][2])
            for i, (number, _, _) in enumerate(shown)
        ]
        return "\n".join(words for (_, words, link), single in zip(shown, alone) if not link or single)

    def _chosen(self, blocks: list[tuple[int, str, int]]) -> set[int]:
        """The best container and the siblings that go with it."""
        n = len(self.tag)
        points, chars, linked = [0.0] * n, [0] * n, [0] * n
        scored = set()
        for number, words, links in blocks:
            chars[number] += len(words)
            linked[number] += links
            tag = self.tag[number]
            heading = tag[0] == "h" and tag[1:].isdigit()
            value = (1 + words.count(",") + min(len(words) / 100, 3)) * (0.2 if heading else 1.0)
            holder = self.parent[number] if tag in ("p", "li", "pre", "td", "blockquote", "dd") or heading else number
            level = 0
            while holder > 0 and level < 6:
                points[holder] += value / (1 if level == 0 else 2 if level == 1 else 3 * level)
                scored.add(holder)
                holder, level = self.parent[holder], level + 1
        if not scored:
            return {0}
        for number in range(n - 1, 0, -1):
            chars[self.parent[number]] += chars[number]
            linked[self.parent[number]] += linked[number]
        final = {}
        for number in sorted(scored):
            base = START_POINTS.get(self.tag[number], 0.0) + (10.0 if self.good[number] else 0.0)
            final[number] = (points[number] + base) * (1 - linked[number] / max(1, chars[number]))
        best = max(final, key=lambda number: (final[number], -number))
        up = best
        while up > 0:  # inside an article, the article is the container
            if self.tag[up] in ("article", "main") and up in final:
                best = up
                break
            up = self.parent[up]
        chosen = {best}
        least = max(10.0, 0.2 * final[best])
        for number in range(1, n):
            if number != best and self.parent[number] == self.parent[best] and chars[number]:
                near = final.get(number, 0.0) >= least and self.tag[number] not in ("ul", "ol")
                tag, plain = self.tag[number], linked[number] <= 0.25 * chars[number]
                prose = plain and (tag in HEADINGS or tag in ("p", "blockquote", "pre") or tag in ("ul", "ol", "dl") and chars[number] >= PROSE_LIST)
                if near or prose:
                    chosen.add(number)
        return chosen


def main_text(html: str | None) -> str:
    """The article text of one page: a line a block."""
    return _Page(html).text() if html else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``pages`` without ``html``, with the main ``text`` and its ``size`` in code points."""
    keep = [f for f in pages.schema.fields if f.name not in (html, text, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(batch.schema.get_field_index(html))]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in keep), text, size])

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in keep), T.StructField(text, T.StringType()), T.StructField(size, T.LongType())])
    return pages.mapInArrow(run, schema)
