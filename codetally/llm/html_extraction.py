"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block elements from the root to it, which goes through a certain
``article`` or ``main`` where there is one. For each path, the text
length and the punctuation marks per block are taken over the page, without link texts. Both series are smoothed along
the page and fused by their product; blocks whose fused value reaches a share of the page's mean, each block weighing as
much as its text, are content. So are blocks between content blocks of the same container, and a heading right before one.

An ``article`` (else ``main``) is a hint, no more: where such parts hold most of the page's fused mass, their blocks'
values get a bonus, and blocks that stand beside content directly in the same marked container stay with it, short lists
and closing lines among them. A small marked card beside a long text changes nothing. Blocks that are mostly links need
a value of their own.

What can't be the article is not read at all: scripts, styles and other markup, the controls of forms and forms without
running text, and elements that are menus, headers, footers, sidebars, notices, adverts or reader comments by their
element, or by a class, id or role made of such a word and words of layout alone (``comments-list``, not
``related-work``). Headings, paragraphs and what stands in them are never left out by name.

Defined cases: a null page, an empty one, and one without content give the empty text. Cut-off tags, comments and
scripts at a page's end are markup and dropped; unclosed elements end where HTML closes them for the reader. Pages are
read whole, in linear time, and judged one by one. A column that already has the name of the result is replaced, all
others are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of the page's mean fused value, weighted by text length, that a block needs.
THRESHOLD = 0.5
#: What the values of marked blocks are multiplied by, where marked parts hold more than this share of the fused mass.
BONUS = 16.0
MOST_MASS = 0.5
#: Weights of a block and its neighbours when a series is smoothed.
SMOOTHING = (0.25, 0.5, 0.25)
MOST_LINKS = 0.6
#: Words outside of links that a block of a form needs for the form to hold running text.
RUNNING_WORDS = 20

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")
_NAME_PART = re.compile(r"[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg xmp noframes".split())
_LEFT_OUT = frozenset("head nav footer aside annotation annotation-xml button select option dialog menu fieldset label".split())
_MATH = frozenset(
    "math mi mo mn ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts mtable mtr mtd mstyle "
    "merror mpadded mphantom mfenced menclose semantics annotation annotation-xml".split()
)
_INLINE = _MATH | frozenset(
    "object a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
_NAMES_LEFT_OUT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended comment comments reply replies respond disqus discussion widget toolbar pagination pager skip hidden".split()
)
_NAMES_HEADER = frozenset(("header", "topbar"))
#: Words of layout that may stand beside such a word in a name.
_LAYOUT = frozenset(
    "area bar block body bottom bottomright box btn buttons center col column container content contents cta desktop first fixed form global header "
    "heading holder icon icons inner item items js large last left level link links list mobile module outer panel post posts primary right row "
    "secondary section site slot small sticky stories story thread title top unit view wrap wrapper".split()
)
#: Elements whose own names say nothing of this kind.
_NEVER_BY_NAME = frozenset("html body article main p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption table".split())


class Block:
    __slots__ = ("form", "heading", "links", "marked", "path", "text", "where")

    def __init__(self, path: int, where: int, marked: int, heading: bool, form: int = 0):
        self.form = form
        self.path, self.where, self.marked, self.heading = path, where, marked, heading
        self.text: list[str] = []
        self.links = 0


def _left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _LEFT_OUT or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id", "role") and tag not in _NEVER_BY_NAME:
            names = _NAMES_LEFT_OUT if in_article else _NAMES_LEFT_OUT | _NAMES_HEADER
            for one in value.split():
                parts = _NAME_PART.findall(one)
                if any(p in names for p in parts) and all(p in names or p in _LAYOUT for p in parts):
                    return True
    return False


def blocks_of(page: str, by_name: bool = True) -> tuple[list[Block], dict[int, str]]:
    """The page's blocks in order, and the kind (article or main) of each marked part.

    ``by_name`` leaves out what its element or name tells to be no article, else the page's head alone.
    """
    paths: dict[tuple[int, str], int] = {}
    # Open elements: tag, path, container (number of the element), marked part, left out, link.
    stack: list[tuple[str, int, int, int, bool, bool]] = [("", 0, 0, 0, False, False)]
    open_tags: Counter = Counter()
    blocks: list[Block] = []
    marks: dict[int, str] = {}
    current: Block | None = None
    elements = form = 0

    def close(tag: str) -> None:
        nonlocal current
        while True:
            last = stack.pop()
            open_tags[last[0]] -= 1
            if last[0] not in _INLINE:
                current = None
            if last[0] == tag:
                return

    position = 0
    while m := _TOKEN.match(page, position):
        position = m.end()
        token = m[0]
        tag = m[2]
        if tag is None:
            if token[0] == "<" and len(token) > 1:
                continue
            tag, path, container, marked, out, link = stack[-1]
            if out:
                continue
            if current is None:
                if token.isspace():
                    continue
                current = Block(path, container, marked, tag in _HEADINGS, form if open_tags["form"] else 0)
                blocks.append(current)
            text = html.unescape(token)
            current.text.append(text)
            if link:
                current.links += len(text.strip())
            continue
        tag = tag.lower()
        if m[1]:
            if open_tags[tag]:
                close(tag)
            elif tag == "p":
                current = None
            continue
        if tag == "svg" and m[3].endswith("/"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, position)
            position = end.start() if end else len(page)
            if end:
                done = page.find(">", position)
                position = done + 1 if done >= 0 else len(page)
            continue
        if tag == "br":
            if current is not None:
                current.text.append(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            current = None
            if open_tags["p"]:
                close("p")
            for other in _CLOSES.get(tag, ()):
                # Only up to the list or table they belong to.
                depth = len(stack) - 1
                while depth > 0 and stack[depth][0] not in ("ul", "ol", "dl", "table", "tbody", other):
                    depth -= 1
                if depth > 0 and stack[depth][0] == other:
                    close(other)
        if tag in _VOID:
            continue
        _, path, container, marked, out, link = stack[-1]
        if not out and tag in ("article", "main") and (not marked or marks[marked] == "main" and tag == "article"):
            marked = elements + 1
            marks[marked] = tag
        out = out or (_left_out(tag, m[3], bool(marked)) if by_name else tag == "head")
        if not inline:
            elements += 1
            if tag == "form" and not open_tags["form"]:
                form = elements
            container = stack[-1][2] if tag in _HEADINGS or tag in ("p", "li", "blockquote", "pre", "ul", "ol") else elements
            path = paths.setdefault((path, tag), len(paths) + 1)
        if not m[3].endswith("/") or tag not in _MATH and tag not in ("p", "div", "span", "a"):
            stack.append((tag, path, container, marked, out, link or tag == "a"))
            open_tags[tag] += 1
    read = [(b.form, "".join(b.text)) for b in blocks]
    running = {f for b, (f, text) in zip(blocks, read, strict=True) if f and len(text.split()) * (1 - b.links / max(1, len(text))) >= RUNNING_WORDS}
    return [b for b in blocks if not b.form or b.form in running], marks


def _smooth(series: np.ndarray) -> np.ndarray:
    padded = np.concatenate([series[:1], series, series[-1:]])
    return SMOOTHING[0] * padded[:-2] + SMOOTHING[1] * padded[1:-1] + SMOOTHING[2] * padded[2:]


def main_text(page: str | None, threshold: float = THRESHOLD, by_name: bool = True) -> str:
    """The content blocks of a page, one per line."""
    if not page:
        return ""
    blocks, marks = blocks_of(page, by_name)
    texts = [" ".join("".join(b.text).split()) for b in blocks]
    kept = [i for i, t in enumerate(texts) if t]
    if not kept:
        return ""
    blocks, texts = [blocks[i] for i in kept], [texts[i] for i in kept]
    content = content_blocks(blocks, texts, marks, threshold)
    return "\n".join(t for t, use in zip(texts, content, strict=True) if use)


def content_blocks(blocks: list[Block], texts: list[str], marks: dict[int, str], threshold: float) -> np.ndarray:
    """Which blocks are content, decided by the ratios of their paths."""
    # Text length and punctuation marks of every path, per block on it; marked parts have paths of their own.
    plain = [max(0, len(t) - b.links) for b, t in zip(blocks, texts, strict=True)]
    length, marks_in, n = Counter(), Counter(), Counter()
    for b, t, size in zip(blocks, texts, plain, strict=True):
        path = b.path, b.marked
        n[path] += 1
        length[path] += size
        marks_in[path] += len(_PUNCTUATION.findall(t)) if size else 0
    long = _smooth(np.array([length[b.path, b.marked] / n[b.path, b.marked] for b in blocks]))
    punctuated = _smooth(np.array([marks_in[b.path, b.marked] / n[b.path, b.marked] for b in blocks]))
    fused = long * (1 + punctuated)

    kind = "article" if "article" in [marks.get(b.marked) for b in blocks] else "main"
    marked = np.array([marks.get(b.marked) == kind for b in blocks])
    trusted = marked & (fused[marked].sum() > MOST_MASS * fused.sum())
    fused = np.where(trusted, BONUS * fused, fused)
    weight = np.array(plain, float)
    enough = fused >= threshold * (fused * weight).sum() / max(1.0, weight.sum())
    linked = np.array([1 - size / len(t) for t, size in zip(texts, plain, strict=True)]) > MOST_LINKS

    content = enough & ~linked
    beside = {b.where for b, use in zip(blocks, content & trusted, strict=True) if use}
    content |= trusted & np.array([b.where in beside for b in blocks])
    for a, b in zip((chosen := np.flatnonzero(content)), chosen[1:]):
        if blocks[a].where == blocks[b].where:
            content[a + 1 : b] |= np.array([blocks[i].where == blocks[a].where for i in range(a + 1, b)], bool)
    for i in range(len(blocks) - 2, -1, -1):
        content[i] |= blocks[i].heading and content[i + 1] and blocks[i].where == blocks[i + 1].where
    return content & (enough | ~linked)


def extract(rows: DataFrame, html_col: str = "html", out_col: str = "main_text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``out_col``, the main text."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([main_text(page, threshold) for page in column.to_pylist()], pa.string())

    return rows.withColumn(out_col, F.arrow_udf(read, "string").asNondeterministic()(F.col(html_col)))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))
