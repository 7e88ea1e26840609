"""Main text of web pages by line-block distribution.

Markup is stripped into one line a block, and every line gets a weight: its length
without links, which markup raises or lowers. Lines of menus, page headers, footers,
sidebars, notices, adverts, forms and comments weigh 0; so do lines that are mostly
links and short scraps without a sentence's end. Lines of an <article> or <main>
that holds most of the text weigh more, and those around it less. Over the lines,
the weights in a sliding window are summed; the main text runs from the line where
that sum first surges to the line where it last dives, without what markup rules
out in between. No mark bounds the text by itself: where the dense block lies
outside a marked one, the windows find it there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches

#: Lines to either side of a window's middle, the sum at which the text surges, and the weight of a line at its edge.
WINDOW, SURGE, EDGE = 2, 40, 5
#: Code points below which a line without a sentence's end is a scrap, what a marked line weighs more, and what one outside it is divided by.
SCRAP, RAISE, LOWER = 25, 100, 50

# Elements whose text never shows, that are never main text, that end a line, and that have no end.
HIDDEN = set("script style noscript template head title svg math iframe object canvas audio video textarea select option datalist".split())
ASIDE = set("nav footer aside form button menu dialog label".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
PROSE = set("p pre blockquote h1 h2 h3 h4 h5 h6 dd figcaption".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
MAIN = {"article", "main"}
#: Words of a class that mark what is not main text; as a whole, or first or last in a name of several parts.
MARKS = set(
    "ad ads advert advertisement adverts advertising banner banners sponsor sponsored sponsors promo promotion promoted"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside complementary widget widgets footer foot header masthead topbar toolbar"
    " comment comments reply replies respond disqus reactions cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup"
    " login search share sharing social related recommended recommendations pagination pager skip copyright outbrain taboola".split()
)
#: Of these, words (and elements) that say how a page is laid out; the others mark what is never main text.
PLACES = set("banner banners sidebar sidebars aside complementary widget widgets footer foot header masthead topbar toolbar notice notices alert popup modal overlay related recommended contentinfo dialog".split())
#: Other parts that a marked name of several parts may have inside an article, where names also tell what a passage is about.
BESIDE = set("area bar block body box button buttons container content count form group icons inner item items link links list post posts article articles section slot stories text thread title unit wrapper".split())
#: Ids and roles that do, as a whole; ids are often slugs of headings.
NAMES = set("ad ads comments sidebar footer header nav navigation navbar menu cookie-notice cookies cookie-banner disqus disqus_thread newsletter respond search-form".split())
ROLES = set("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())
#: First parts of a class that say how a wrapper is laid out, not what it holds.
LAYOUT = set("has with no without is layout l page col row grid".split())

_RAW = "script|style|noscript|template|svg|math|iframe|textarea|title"
_PART = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<[/!?]?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[/!?]?[a-zA-Z][^<>]*>?",
    re.S | re.I,
)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"(?<=\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPACE = re.compile(r"\s+")
_END = re.compile(r"[.!?…:;。！？]")


def _marked(tag: str, inside: bool) -> set[str]:
    """The words by which an element's names mark it; inside an article a name of several
    parts only counts if all of them are such words or usual beside them."""
    out = set()
    for kind, value in _ATTR.findall(tag):
        for word in value.strip("\"'").lower().split():
            parts = [x for x in re.split(r"[-_]+", word) if x]
            if kind.lower() == "role":
                out |= {word} & ROLES
            elif kind.lower() == "id":
                out |= set(parts) & MARKS or {word} if word in NAMES else set()
            elif parts and parts[0] not in LAYOUT and (not inside or all(x in MARKS or x in BESIDE or x.isdigit() for x in parts)):
                out |= {parts[0], parts[-1]} & MARKS
    return out


@dataclass
class Node:
    """An element: where it stands, and what its tag and its marks say."""

    tag: str
    parent: int
    inside: int  # the outermost article or main that holds it, or -1
    link: bool
    prose: bool
    heading: bool
    bars: int  # 0 no, 1 by where it stands, 2 as it never shows, 3 by what it is
    size: int = 0
    holds: bool = False  # a first heading, a main or an article without a mark
    heads: bool = False  # a first heading or a main


def parse(page: str) -> tuple[list[Node], list[list[tuple[str, int]]]]:
    """Elements, parents first, and lines: the pieces of each block with their elements."""
    nodes = [Node("", -1, -1, False, False, False, 0)]
    stack, out, line = [0], [], []

    def piece(text: str) -> None:
        line.append((html.unescape(text), stack[-1]))

    def close(depth: int) -> None:
        del stack[depth:]

    def place(tags, until) -> int:
        """Depth of the innermost open element of tags, not beyond one of until; 0 if there is none."""
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                return k
            if tag in until:
                return 0
        return 0

    at = 0
    for m in _PART.finditer(page):
        if m.start() > at:
            piece(page[at : m.start()])
        at = m.end()
        name = _NAME.match(m[0])
        if not name or m[1]:
            continue
        end, tag = name[1], name[2].lower()
        wide = tag in BLOCK or tag in HIDDEN or tag in ASIDE
        if tag == "br":
            line.append((" ", stack[-1]))
        elif wide and line:
            out.append(line)
            line = []
        if tag in VOID or m[0].endswith("/>"):
            continue
        if end:
            depth = place({tag}, () if wide else BLOCK)
            if depth:
                close(depth)
            continue
        if tag in BLOCK:  # ends an open paragraph, as an item ends the one before it
            depth = place({"p"}, BLOCK - {"p"}) or (tag == "li" and place({"li"}, {"ul", "ol"}))
            if depth:
                close(depth)
        up = nodes[stack[-1]]
        marked = set() if tag in ("html", "body") or tag in HEADING else _marked(m[0], up.inside >= 0)
        marked |= {tag} & ASIDE or ({tag} if tag == "header" and up.inside < 0 else set())
        bars = 2 if tag in HIDDEN else 0 if not marked else 1 if marked <= PLACES else 3
        own = up.inside if up.inside >= 0 else len(nodes) if tag in MAIN and not marked else -1
        block = tag in BLOCK
        nodes.append(Node(tag, stack[-1], own, up.link or tag == "a", tag in PROSE if block else up.prose, tag in HEADING if block else up.heading, bars))
        if tag == "h1" or (tag in MAIN and not marked):
            nodes[stack[-1]].holds, nodes[stack[-1]].heads = True, tag != "article"
        stack.append(len(nodes) - 1)
    if at < len(page):
        piece(page[at:])
    if line:
        out.append(line)
    return nodes, out


def _barred(nodes: list[Node], lines: list[list[tuple[str, int]]]) -> list[bool]:
    """Which elements are no main text. A mark does not count on what holds most of the
    text and its heading. Where no other text is left, a mark of a place does not count on
    what holds most of it; comments, menus, forms and adverts stay out even then."""
    for line in lines:
        for text, k in line:
            nodes[k].size += len(text.strip())
    hidden = [n.bars == 2 for n in nodes]
    for k in range(1, len(nodes)):
        hidden[k] = hidden[k] or hidden[nodes[k].parent]
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[nodes[k].parent]
        up.size += 0 if hidden[k] else nodes[k].size
        up.holds, up.heads = up.holds or nodes[k].holds, up.heads or nodes[k].heads
    all_ = nodes[0].size

    def bars(strict: bool) -> list[bool]:
        out = [False] * len(nodes)
        for k in range(1, len(nodes)):
            n = nodes[k]
            wraps = 2 * n.size > all_ and (n.heads if n.bars == 3 else n.holds or not strict)
            out[k] = out[n.parent] or n.bars == 2 or (n.bars > 0 and not wraps)
        return out

    out = bars(True)
    return out if any(t.strip() for line in lines for t, k in line if not out[k]) else bars(False)


@dataclass
class Line:
    text: str
    weight: float
    main: bool


def lines(page: str) -> list[Line]:
    """A line a block, with its weight, and whether it may be main text."""
    nodes, raw = parse(page)
    barred = _barred(nodes, raw)
    found, by_main = [], {}
    for line in raw:
        text = _SPACE.sub(" ", "".join(t for t, k in line if not barred[k])).strip()
        if not text:  # what markup rules out is a line of weight 0
            if _SPACE.sub("", "".join(t for t, _ in line)):
                found.append((Line("", 0, False), -1))
            continue
        links = sum(len(t.strip()) for t, k in line if nodes[k].link and not barred[k])
        last = nodes[next(k for t, k in line if not barred[k] and t.strip())]
        plain = len(text) - links
        scrap = len(text) < SCRAP and not last.prose and not _END.search(text)
        weight = 0.0 if 2 * links > len(text) or scrap else float(max(plain, EDGE * last.prose) + EDGE * last.heading)
        found.append((Line(text, weight, True), last.inside))
        by_main[last.inside] = by_main.get(last.inside, 0) + weight
    dense = {k for k, n in by_main.items() if k >= 0 and n and 2 * n >= sum(by_main.values())}
    if dense:
        for line, inside in found:
            if line.main:
                line.weight = len(line.text) + RAISE if inside in dense else line.weight / LOWER
    return [x for x, _ in found]


def bounds(weights: list[float]) -> tuple[int, int] | None:
    """First and last line of the main text: the surge and the dive of the window sums.
    Weights at the edges are at least EDGE, or the largest if none is."""
    n = len(weights)
    total = [sum(weights[max(0, k - WINDOW) : k + WINDOW + 1]) for k in range(n)]
    if not n or max(weights) <= 0:
        return None
    surge, edge = min(SURGE, max(total)), min(EDGE, max(weights))
    over = [k for k in range(n) if weights[k] >= edge and total[k] >= surge]
    return (over[0], over[-1]) if over else None


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by one newline; empty if there are none."""
    found = lines(page or "")
    where = bounds([x.weight for x in found])
    if where is None:  # nothing but scraps and links: there is no surge, and all of them are the text
        return "\n".join(x.text for x in found if x.main)
    return "\n".join(x.text for x in found[where[0] : where[1] + 1] if x.main)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    A null or empty page has an empty text of 0 code points. Repeated rows are
    extracted each; null ids and urls stay; further columns are not read, whatever
    their names. An empty table gives an empty one. No shuffle.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
