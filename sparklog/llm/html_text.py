"""Main text of a web page by the distribution of text over its line blocks.

Markup is stripped first: comments, scripts and styles go; elements that are boilerplate by
their tag (menus, footers, forms, asides ...) or by a class, id or role (adverts, notices,
reader comments ...) leave an empty gap; each block-level tag ends a line.  Then the text
lengths, links not counted, are summed over sliding windows of ``WINDOW`` lines.  Text begins
at a surge point, where the sum exceeds the threshold, and ends at the dive point, where the
sum falls to nothing; the lines between are kept.  Where a page marks its article, lines
outside count nothing and lines within always exceed the threshold.

Character references are decoded, white space within a block becomes one blank, blocks are
joined by a line feed.  Null or empty pages give the empty text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import by_bytes

BATCH_BYTES = 4 << 20
WINDOW, SURGE = 3, 40

_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title|object|canvas|video|audio|select)\b[^>]*>.*?(?:</\1\s*>|\Z)")
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""")
_NAMES = re.compile(r"""(?i)\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

#: Tags that end a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Tags without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags and names of what isn't article text.
DROPPED_TAGS = frozenset("aside button dialog footer form head menu nav".split())
DROPPED_NAMES = frozenset(
    "ad ads advert advertisement adverts alert alertdialog banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended related search share sharing sidebar skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
#: Of names of several parts these count only whole, as articles have parts named after them.
_WHOLE_ONLY = frozenset({"header", "tags", "form", "search", "alert"})
_ROOTS = frozenset({"article", "main"})


def _dropped(tag: str, attributes: str, within: bool) -> bool:
    if tag in DROPPED_TAGS or tag == "header" and not within:
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for groups in _NAMES.findall(attributes):
        for name in "".join(groups).lower().split():
            if name in DROPPED_NAMES and not (name == "header" and within):
                return True
            parts = re.split(r"[-_]+", name)
            if len(parts) > 1 and (parts[0] in DROPPED_NAMES - _WHOLE_ONLY or parts[-1] in DROPPED_NAMES - _WHOLE_ONLY):
                return True
    return False


def lines(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """The page's lines as (text, length without links, within an article), and whether it marks an article."""
    page = _HIDDEN.sub(" ", page)
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked = depth = links = skip_depth = 0
    skipping = ""
    marked = False

    def end_line() -> None:
        nonlocal linked
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            out.append((line, max(0, len(line) - linked), depth > 0))
        text.clear()
        linked = 0

    at = 0
    for m in _TAG.finditer(page):
        if not skipping and m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                linked += len(" ".join(piece.split()))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing, empty = m[1] == "/", tag in VOID or (m[3] or "").endswith("/")
        if skipping:
            if tag == skipping and not empty:
                skip_depth += -1 if closing else 1
            if not closing and tag in _ROOTS and skipping != tag:
                skip_depth = 0  # the element before was never closed
            if skip_depth > 0:
                continue
            skipping = ""
            if tag not in _ROOTS:
                continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag in BLOCKS:
            end_line()
            links = 0
        elif tag in ("br", "td", "th", "img", "option"):
            text.append(" ")
        if not closing and not empty and _dropped(tag, m[3] or "", depth > 0):
            end_line()
            out.extend([("", 0, False)] * WINDOW)
            skipping, skip_depth = tag, 1
        elif tag in _ROOTS:
            marked = True
            depth = max(0, depth + (-1 if closing else 1))
    if not skipping:
        text.append(page[at:])
    end_line()
    return out, marked


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, marked = lines(page)
    if marked and any(x and within for x, _, within in found):
        size = [max(n, SURGE + 1) if within and x else 0 for x, n, within in found]
    else:
        size = [n for _, n, _ in found]
    sums = [sum(size[i : i + WINDOW]) for i in range(len(size))]
    surge = min(SURGE, max(sums, default=0) // 4)
    keep, inside = [], False
    for i, (line, _, _) in enumerate(found):
        if not inside and size[i] and sums[i] > surge:
            inside = True
        elif inside and not sums[i]:
            inside = False
        if inside and line and (size[i] or not marked):
            keep.append(line)
    return "\n".join(keep)


def op5(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html", BATCH_BYTES):
            made = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
