"""Main text of web pages by tag-path ratios.

Each page is parsed into text blocks, each with its root-to-leaf tag path. Per path the operator adds up text length and
punctuation over the path's blocks; the two ratios (per block) run along the page, are smoothed with a
Gaussian, fused to length x (1 + punctuation), and thresholded at the standard deviation. Paths through
elements whose tag, class, id or role names boilerplate (menus, notices, forms, reader comments ...) have ratio 0. The
content element is the one that holds ``HOLDS`` of the selected text: the outermost
article or main element if there is one, else the deepest container. All its blocks that are not boilerplate are the text, so short paragraphs
between long ones stay. Without an article or main element titles, standfirsts and sections beside the deepest container are text too;
outside it only blocks that look like menus or legal lines (mostly links, short with separators, a copyright mark) are left out.

Pages are independent (no shuffle). A null, empty or text-free page has the empty text; character references are decoded;
unclosed elements end where HTML says so (a block ends an open paragraph). Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.tables import beside, ship, table

HOLDS = 0.9
KERNEL = np.array([0.2, 0.6, 0.2])

# Names of HTML elements by their role, and the words that mark boilerplate in class, id and role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPLIT = {"td", "th", "br", "option"}
LEAVES = set("p li h1 h2 h3 h4 h5 h6 blockquote pre dd dt tr td th figcaption".split())
BOILER_TAGS = set("aside button dialog footer form head iframe input label menu nav noscript object script select style svg template textarea".split())
BOILER_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus "
                   "footer gdpr login menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply "
                   "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo".split())
HEAD_WORDS = {"header", "masthead", "topbar"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PUNCTUATION = re.compile(r"[.,;:!?¡¿…。、，！？；：]")
MENU = re.compile(r"^(?:©|\(c\)|copyright\b)|^[^.!?]{0,80}[|•·»›][^.!?]{0,80}$", re.IGNORECASE)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Page(HTMLParser):
    """Text blocks in page order: (text, path, chain of elements, boilerplate?, characters in links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, element, boilerplate, inside an article
        self.tags: list[str] = []
        self.blocks: list[tuple[str, tuple[str, ...], tuple[int, ...], bool, int]] = []
        self.text: list[str] = []
        self.linked = 0
        self.at: list[tuple[str, int, bool, bool]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text, linked, self.linked = [], self.linked, 0
        if text:
            self.blocks.append((text, tuple(s[0] for s in self.at), tuple(s[1] for s in self.at), bool(self.at) and self.at[-1][2], linked))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            self.close_to({"p"}, BLOCKS - {"p"})
        if tag in SAME_ENDS:
            self.flush()
            self.close_to(SAME_ENDS[tag], {"ul", "ol", "dl", "table"})
        if tag in SPLIT:
            self.text.append(" ")
        if tag in VOID:
            return
        boiler, inside = self.stack[-1][2:] if self.stack else (False, False)
        inside = inside or tag in ("article", "main")
        names = {w.lower() for k, v in attrs if k in ("class", "id", "role") and v for w in WORDS.findall(v)}
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "")) for k, v in attrs)
        boiler = boiler or hidden or tag in BOILER_TAGS or (tag not in ("html", "body", "article", "main") and bool(names & BOILER_WORDS)) or (
            not inside and (tag == "header" or bool(names & HEAD_WORDS)))
        self.stack.append((tag, len(self.tags), boiler, inside))
        self.tags.append(tag)

    def close_to(self, tags: set[str], stop: set[str]) -> None:
        """End the nearest open element of these, unless one of ``stop`` stands between."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                del self.stack[k:]
                return
            if self.stack[k][0] in stop:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        if tag in SPLIT:
            self.text.append(" ")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if any(s[0] in BLOCKS for s in self.stack[k:]):
                    self.flush()
                del self.stack[k:]
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        if not any(not t.isspace() for t in self.text):
            self.at = [s for s in self.stack if s[0] in BLOCKS or s[2]] if data.strip() else self.at
        elif (self.stack[-1][2] if self.stack else False) != (self.at[-1][2] if self.at else False):
            self.flush()  # boilerplate inside a line of text, or text after it
            self.at = [s for s in self.stack if s[0] in BLOCKS or s[2]]
        self.text.append(data)
        if any(s[0] == "a" for s in self.stack):
            self.linked += len("".join(data.split()))


def path_scores(blocks) -> np.ndarray:
    """The fused, smoothed tag-path ratio of each block."""
    sums: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0, 0])
    for text, path, _, boiler, _ in blocks:
        s = sums[path]
        if not boiler:
            s[0] += len(text)
            s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    length = np.array([0 if b[3] else sums[b[1]][0] / sums[b[1]][2] for b in blocks], float)
    marks = np.array([0 if b[3] else sums[b[1]][1] / sums[b[1]][2] for b in blocks], float)
    smooth = [np.convolve(np.pad(x, 1, "edge"), KERNEL, "valid") for x in (length, marks)]
    return smooth[0] * (1 + smooth[1])


def _menu_like(block) -> bool:
    text, path, _, _, linked = block
    return not (path and path[-1] in HEADINGS) and (2 * linked >= len(text.replace(" ", "")) or bool(MENU.search(text)))


def main_text(html: str) -> str:
    cut = html.rfind("<!--")  # a comment that is not closed reaches to the end
    if cut >= 0 and "-->" not in html[cut:] and "</script" not in html[cut:]:
        html = html[:cut]
    page = Page()
    page.feed(html)
    page.close()
    page.flush()
    blocks = page.blocks
    if not any(not b[3] for b in blocks):
        return ""
    score = path_scores(blocks)
    least = score.std()
    chosen = [i for i, b in enumerate(blocks) if not b[3] and score[i] >= least]
    if not chosen:
        chosen = [i for i, b in enumerate(blocks) if not b[3]]
    weight: dict[int, int] = defaultdict(int)
    for i in chosen:
        for e in blocks[i][2]:
            weight[e] += len(blocks[i][0])
    total = sum(len(blocks[i][0]) for i in chosen)
    holding = [e for e in sorted(weight) if weight[e] >= HOLDS * total]  # one chain: parents have smaller numbers
    articles = [e for e in holding if page.tags[e] in ("article", "main")]
    containers = [e for e in holding if page.tags[e] not in LEAVES]
    if articles:
        kept = [b for b in blocks if articles[0] in b[2]]
    else:
        kept = [b for b in blocks if not containers or containers[-1] in b[2] or not _menu_like(b)]
    return "\n\n".join(b[0] for b in kept if not b[3])


def _extract(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        texts = [main_text(h) if h else "" for h in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["row", "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every page, with its main text and that text's length in code points."""
    ship(pages.sparkSession)
    src = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return src.mapInArrow(_extract, beside(src, "row", "text string, n_chars long")).select("row.*", "text", "n_chars")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
