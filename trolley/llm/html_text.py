"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. Scripts, styles, comments and elements whose
tag, class, id or role says navigation, header, footer, advert, form, notice, sharing or reader
comments are cut out and leave a gap, as do copyright lines outside an article where there is other text. A line that is
nothing but links has no length. The lengths of the lines are summed over a sliding window. A block of text
begins at a surge point, where the sum reaches a threshold taken from the page's own sums, and
ends at a dive point, where it falls below half of that or a whole window is empty; the text
between is kept. This decides on every page. A block then takes in the other lines of the
elements it begins in (a section, a plain div, the article around them; not the body): headings, short
paragraphs, lists of links and table rows between or after its paragraphs. An ``article`` without a
surge is no main text."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_batches, table

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=\"'/]++)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# Elements whose content is no text, elements that are no main text, elements
# that begin and end a line, elements without content, values of class, id or role, words that
# may stand beside these in a compound value, values that mark a section, headings, elements that a
# marked one does not hold, elements
# that hold lines together, elements that values never strip, elements that end an open p, and for elements with an optional end
# tag: the elements that their start ends, and those that bound it.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select option".split())
APART = frozenset("nav header footer aside form menu button dialog fieldset".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section
    summary table tbody td tfoot th thead tr ul""".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
HINTS = frozenset("""ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion cookie cookies
    consent gdpr notice popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pager pagination
    footer comment comments disqus respond share sharing social related recommended subscribe newsletter signup login
    search masthead toolbar contentinfo complementary alert dialog""".split())
GLUE = frozenset("""section sections container wrapper wrap box block list area inner outer bar unit slot top bottom left right
    site page global primary secondary content holder panel region group links link text form buttons item items policy message""".split())
OF_SECTION = frozenset("ad ads advert advertisement comment comments disqus respond sidebar newsletter subscribe cookie cookies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GAP = ("", -1, -1, 0, False, -1)
LANDMARKS = frozenset("article main h1".split())
HOLDERS = frozenset("article div main section".split())
LISTS = frozenset("ul ol dl menu dir table".split())
ENOUGH = 120    # characters in a window that are text on any page
NOTICE = re.compile(r"(?:copyright\s*)?(?:©|\(c\)\s)|copyright\s+\d{4}\b", re.I)
EDGES = frozenset("article main section nav header footer aside h1 body".split())


KEPT = frozenset("html body head main article h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - frozenset("body br caption head html legend tbody td tfoot th thead tr".split())
CELLS = frozenset("table caption td th button".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
IMPLIED = {
    "li": (("li",), CELLS | {"ul", "ol", "menu", "dir"}),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), CELLS | {"dl"})),
    **dict.fromkeys(("td", "th"), (("td", "th", "caption"), frozenset(["table"]))),
    "tr": (("tr", "caption"), frozenset(["table"])),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "caption"), frozenset(["table"]))),
}


def marked(tag: str, attrs: str, in_main: bool) -> bool:
    """Does a value of class, id or role mark the element as no main text: as a whole, or as a
    compound of such words and words of place and shape only (``ad-banner``, ``comments-section``,
    but not ``no-sidebar``, ``related-work`` or ``comments-open``)."""
    if tag in KEPT or not attrs:
        return False
    for m in ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id", "role"):
            for value in (m[2] or m[3] or m[4] or "").lower().split():
                words = [w for w in re.split(r"[-_]+", value) if w]
                hints = [w for w in words if w in (OF_SECTION if tag == "section" else HINTS) or w == "header" and not in_main]
                if hints and len(hints) + sum(w in GLUE for w in words if w not in hints) == len(words):
                    return True
    return False


def tokens_of(page: str) -> list[tuple[str, str, str, bool]]:
    """(text before the tag, tag, attributes, closing) of every tag outside raw elements and
    comments; the last has no tag."""
    out: list[tuple[str, str, str, bool]] = []
    parts: list[str] = []
    at, raw_until = 0, -1
    for m in TOKEN.finditer(page):
        if m.start() < raw_until:
            continue
        parts.append(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        closing, tag, attrs = bool(m[1]), m[2].lower(), m[3] or ""
        if tag in RAW and not closing:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(page, at)
                at = raw_until = end.end() if end else len(page)
            continue
        out.append(("".join(parts), tag, attrs, closing))
        parts.clear()
    return [*out, ("".join(parts) + page[at:], "", "", False)]


def ends_of(tokens: list[tuple[str, str, str, bool]]) -> dict[int, tuple[int, bool]]:
    """Per start tag (place in ``tokens``): the place where its element ends, and whether that
    is its own end tag. A missing end tag is implied as HTML does for p, li, dt, dd and the
    parts of a table; any other unclosed element ends with its parent or at the next landmark."""
    ends: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []
    where: dict[str, list[int]] = {}        # places on the stack by tag
    edges = [k for k, t in enumerate(tokens) if t[1] in EDGES]

    def top(names) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def pop(to: int, k: int, own: bool, implied: bool) -> None:
        """End the elements from the stack's place ``to`` up at token ``k``."""
        while len(stack) > to:
            tag, start = stack.pop()
            if not tag:
                continue
            where[tag].pop()
            mine = len(stack) == to
            end = k
            if not (mine and (own or implied)) and tag not in IMPLIED and tag != "p":
                nxt = bisect_right(edges, start)
                end = min(k, edges[nxt]) if nxt < len(edges) else k
            ends[start] = (end, mine and own)

    for k, (_, tag, attrs, closing) in enumerate(tokens):
        if closing:
            at = top((tag,))
            if at < 0 or tag not in TABLE and at < top(CELLS - {tag}):
                continue
            if tag not in BLOCK and any(stack[j][0] in BLOCK for j in range(at + 1, len(stack))):
                ends[stack[at][1]] = (k, True)      # a wrongly nested inline element ends alone
                stack[at] = ("", -1)
                where[tag].pop()
            else:
                pop(at, k, True, False)
        elif tag and tag not in EMPTY and not attrs.rstrip().endswith("/"):
            if tag in ENDS_P and (at := top(("p",))) > top(CELLS):
                pop(at, k, False, True)
            if tag in IMPLIED and (at := top(IMPLIED[tag][0])) > top(IMPLIED[tag][1]):
                pop(at, k, False, True)
            where.setdefault(tag, []).append(len(stack))
            stack.append((tag, k))
        elif tag in ENDS_P and (at := top(("p",))) > top(CELLS):
            pop(at, k, False, True)
    pop(0, len(tokens) - 1, False, False)
    return ends


def lines_of(page: str) -> list[tuple[str, int, int, int, bool, int]]:
    """(text, element that holds it, the list or table in that it is in, or else the element,
    length, is a heading, article or main element around it) of every line; one that is nothing but links has no length. Where
    articles and main elements hold a fifth of all lengths or more, the lines outside are cut out. An element is known
    by the place of its start tag, -1 where only the body holds the line. What was cut out is an
    empty line. A marked element that holds an article, a main element or a first heading is a
    frame of the page and is not cut out."""
    tokens = tokens_of(page)
    ends = ends_of(tokens)
    marks = [k for k, t in enumerate(tokens) if t[1] in LANDMARKS and not t[3]]
    lines: list[tuple[str, int, int, int, bool, int]] = []
    within: list[bool] = []
    notices: list[int] = []
    parts: list[str] = []
    plain = heading = False
    until = -1                  # the token that ends the element that is cut out
    link_until = heading_until = -1
    main_depth = 0
    holders: list[tuple[int, int]] = [(-1, len(tokens))]     # (place of the start, of the end)
    groups, frames = list(holders), list(holders)       # lists and tables, too; articles and main elements only

    def flush() -> None:
        nonlocal plain, heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            if not main_depth and NOTICE.match(text):
                notices.append(len(lines))
            lines.append((text, holders[-1][0], groups[-1][0], len(text) if plain else 0, heading, frames[-1][0]))
            within.append(main_depth > 0)
        parts.clear()
        plain = heading = False

    def gap() -> None:
        lines.append(GAP)
        within.append(False)

    for k, (text, tag, attrs, closing) in enumerate(tokens):
        if k < until:
            continue
        if k > until and text:
            parts.append(text)
            if not text.isspace():
                plain, heading = plain or k > link_until, heading or k <= heading_until
        if k == until:
            gap()
            if own:
                continue
        if tag in BLOCK:
            flush()
        for open_ in (holders, groups, frames):
            while open_[-1][1] <= k and len(open_) > 1:
                open_.pop()
        if closing:
            if tag in MAIN and main_depth:
                main_depth -= 1
            continue
        if k not in ends:
            continue
        apart = tag in APART and not (tag == "header" and main_depth)    # an article's own heading
        if not apart and marked(tag, attrs, main_depth > 0):
            at = bisect_right(marks, k)
            apart = at == len(marks) or marks[at] >= ends[k][0]
        if apart:
            if tag not in BLOCK:
                flush()
            until, own = ends[k]
            gap()
        elif tag == "a":
            link_until = ends[k][0]
        else:
            if tag in MAIN:
                main_depth += 1
                frames.append((k, ends[k][0]))
            if tag in HOLDERS:
                holders.append((k, ends[k][0]))
                groups.append(holders[-1])
            elif tag in LISTS:
                groups.append((k, ends[k][0]))
            elif tag in HEADINGS:
                heading_until = ends[k][0]
    flush()
    if sum(line[3] for line in lines) - sum(lines[k][3] for k in notices) >= ENOUGH:    # beside any text
        for k in notices:
            lines[k] = GAP
    if 5 * sum(line[3] for line, x in zip(lines, within, strict=True) if x) >= max(1, sum(line[3] for line in lines)):
        lines = [line if x else GAP for line, x in zip(lines, within, strict=True)]
    return lines


def surge_of(size: np.ndarray, sums: np.ndarray, share: float, enough: int) -> float:
    """``share`` of the window sum that half of the text's characters lie below, but at most
    ``enough`` characters, so that a giant line does not outweigh ordinary paragraphs."""
    order = np.argsort(sums, kind="stable")
    total = np.cumsum(size[order])
    if not len(total) or not total[-1]:
        return 1.0
    return max(1.0, min(float(enough), share * float(sums[order[np.searchsorted(total, total[-1] / 2)]])))


def main_text(page: str | None, window: int = 3, share: float = 0.25, enough: int = ENOUGH) -> str:
    """Kept lines joined by a line feed. A block begins where the window sum of a line and those
    after it in its element, list or table (for a heading, in any) reaches the page's surge (see surge_of), and ends where that of a line and those before
    (in the same element, list or table, if it is in one) falls below half of it or ``window`` lines in a row have no length. Lines between a dive and
    a next surge without such a gap are kept, and so are all lines of an element (article, main,
    section, div) that directly holds a line at which a block surges."""
    if not page:
        return ""
    lines = lines_of(page)
    size = np.array([line[3] for line in lines], dtype=np.int64)
    if not size.any():
        return ""
    sums = np.convolve(size, np.ones(window, dtype=int))[:len(size)]     # of a line and those before
    mine = np.array([sum(n for _, _, g, n, *_ in lines[max(0, k - window + 1):k + 1] if g == line[2] or line[2] < 0)
                     for k, line in enumerate(lines)], dtype=np.int64)      # the same, inside the line's element
    surge = surge_of(size, mine, share, enough)
    keep, holders = np.zeros(len(lines), bool), set()
    low: list[int] | None = None        # lines since the dive; none before the first surge
    inside = False
    for k, (text, holder, group, _, heading, frame) in enumerate(lines):
        # of a line and those after: a menu entry does not surge with the text behind its element
        own = sum(n for _, _, g, n, *_ in lines[k:k + window] if heading or g == group)
        if sums[k] == 0:
            inside, low = False, None
        elif size[k] and own >= surge:
            keep[low or []] = True
            inside, low = True, []
            holders |= {holder, frame}
        elif mine[k] < surge / 2:
            inside = False
        if text:
            if inside:
                keep[k] = True
            elif low is not None:
                low.append(k)
    holders.discard(-1)
    return "\n".join(text for k, (text, holder, _, _, _, frame) in enumerate(lines) if text and (keep[k] or holder in holders or frame in holders))


def extracted(page: Column) -> Column:
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)
    return extract(page)


def extract_text(pages: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the string column ``into`` (replacing one of that name): the main text of
    the whole html. Null, empty and textless pages give an empty text. Row for row; repeated
    rows stay repeated; pages are read whole and nothing is capped."""
    bounded_batches(pages.sparkSession)
    return pages.withColumn(into, extracted(F.col(page)))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))
