"""HTML extraction by nearest-URL page differencing.

A page is cut into lines, one per block of its markup, with white space folded and character references
decoded; scripts, styles, heads and form fields hold no text. Pages are put in order of URL path within each
host, and each page is compared with the neighbours whose paths share the longer prefixes (the nearer in that
order, then the one before, of equals), of the ``REACH`` on each side, as templates take turns on a site. The lines
of both pages are aligned by longest common subsequence and lines that both have are template: menus, notices,
adverts and footers go because the page beside has them too, however they are marked. Of the neighbours, the
``NEAR`` nearest that share lines count. A neighbour with which a page shares more than nine tenths of its words is
a copy that shows nothing and is passed over; pages of a host with equal html are one page.

Where this leaves doubt the markup decides. A shared line inside an article or main element stays, for a passage
that is quoted twice is text. A line that no neighbour shares goes if its element, its role or a whole word of its
class says that it is something else, as on a page that has no neighbour; its words never decide on html,
body, article and main.

Order needs no task that holds a host: keys and line hashes (never text) are written once, range-sorted and
numbered, and each run of numbers is compared in one task that also gets the ``REACH`` pages on each side of it.
What a page shares meets its lines, not its html: those that markup removes anyway stay behind, the rest is compressed.

Null and empty html give an empty text. Each row is judged by its host, path and html, so ids may be null or
repeat. Null URLs are one host. An empty table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Fixed names: elements without text of the page, elements that are not its main text, and elements that end a line.
SILENT = frozenset("script style noscript template select option textarea input iframe svg canvas object head title datalist".split())
ASIDE = frozenset("nav header footer aside form button dialog menu".split())
BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption blockquote pre hr br address figure figcaption details summary body html nav header footer aside form".split())
#: Elements without an end tag, elements whose content is no markup, and elements that do not end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe"))
WITHIN_P = frozenset(("br", "td", "th", "tr", "caption", "summary", "figcaption"))
#: Fixed words of class, id and role, compared whole, that mark what is not the main text.
MARKED = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar side-bar aside complementary contentinfo cookie cookies cookie-notice cookie-banner consent notice popup modal newsletter comment comments disqus_thread related pagination pager site-header site-footer page-header page-footer share-buttons social-links login-form search-form search-box".split()
)
#: How many pages on each side are looked at, and how many of those that share lines count.
REACH, NEAR = 24, 2
WHOLE = ("html", "body", "article", "main")
#: Quotes count only at the start of an attribute's value; a tag whose quotes do not pair up ends at its first '>'.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)|=)*+(?=>)|[^>]*)>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_BLANK, _START, _NAME = re.compile(r"\s+"), re.compile(r"</?[a-zA-Z]"), re.compile(r"/?[a-zA-Z]")


def _is_marked(name: str, attributes: str) -> bool:
    for key, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if key.lower() == "hidden" or (key.lower() == "aria-hidden" and value == "true"):
            return True
        if key.lower() in ("class", "id", "role") and name not in WHOLE and not MARKED.isdisjoint(value.split()):
            return True
    return False


#: What markup says of a line: it is in an article, or it is something else.
ARTICLE, OTHER = 1, 2


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, marks) of each line of a page: ARTICLE where an article or main element holds it, OTHER where its markup names something else."""
    out: list[tuple[str, int]] = []
    open_: list[tuple[str, int, bool]] = []  # element, marks, silent
    held: list[str] = []
    page, at = page or "", 0

    def end_line() -> None:
        text = _BLANK.sub(" ", references.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((text, open_[-1][1] if open_ else 0))

    while at < len(page):
        m = _TOKEN.match(page, at)
        if not m:  # a tag that the page's end cuts off
            if _START.match(page, at):
                break
            held.append("<")
            at += 1
            continue
        at = m.end()
        closing, name, attributes, text = m[1], m[2], m[3], m[4]
        if text is not None:
            if text == "<" and _NAME.match(page, at):
                break
            if not open_ or not open_[-1][2]:
                held.append(text)
        elif name is not None:
            name = name.lower()
            ends = name in BLOCKS or name in ASIDE
            if ends:
                end_line()
            if closing:
                if any(x[0] == name for x in open_):
                    if not ends and any(x[0] in BLOCKS or x[0] in ASIDE for x in open_[_last(open_, name) :]):
                        end_line()
                    del open_[_last(open_, name) :]
            elif name not in VOID:
                if ends and name not in WITHIN_P and any(x[0] == "p" for x in open_):  # a block ends the paragraph it stands in
                    del open_[_last(open_, "p") :]
                if name == "li" and open_ and open_[-1][0] == "li":
                    open_.pop()
                up = open_[-1] if open_ else ("", 0, False)
                marks = up[1] | (ARTICLE if name in ("article", "main") else 0)
                # An article's own header holds its headline.
                if (name in ASIDE and not (name == "header" and marks & ARTICLE)) or _is_marked(name, attributes):
                    marks |= OTHER
                open_.append((name, marks, up[2] or name in SILENT))
                if name in RAW:
                    at = re.compile(rf"</{name}\s*>|$", re.I).search(page, at).end()
                    open_.pop()
    end_line()
    return out


def _last(open_: list[tuple[str, int, bool]], name: str) -> int:
    return max(k for k, x in enumerate(open_) if x[0] == name)


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each prefix of ``b``, by one long number's bits."""
    n = len(b)
    every, where = (1 << n) - 1, {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    row = every
    for x in a:
        met = row & where.get(x, 0)
        row = ((row + met) | (row - met)) & every
    bits = np.unpackbits(np.frombuffer((~row & every).to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of two lists of line hashes; memory grows with their lengths alone."""
    both = set(a) & set(b)
    places, a, b = [i for i, x in enumerate(a) if x in both], [x for x in a if x in both], [x for x in b if x in both]
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(a1)
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
            continue
        half = (a0 + a1) // 2
        up = _prefix_lengths(a[a0:half], b[b0:b1])
        down = _prefix_lengths(a[half:a1][::-1], b[b0:b1][::-1])
        cut = b0 + int((up + down[::-1]).argmax())
        todo += [(a0, half, b0, cut), (half, a1, cut, b1)]
    return [places[i] for i in sorted(out)]


def shared_places(own: list[int], sizes: list[int], path: str, others: list[tuple[str, list[int]]], near: int = NEAR, copy: float = 0.9) -> list[int]:
    """Places of ``own`` (line hashes, with their words in ``sizes``) that its nearest neighbours share; ``others``: (path, line hashes) in order of distance."""

    def prefix(other: str) -> int:
        n = min(len(path), len(other))
        return next((k for k in range(n) if path[k] != other[k]), n)

    out: set[int] = set()
    mine, total = set(own), sum(sizes)
    some = [x for x in others if not mine.isdisjoint(x[1])]
    for _, theirs in sorted(some, key=lambda x: -prefix(x[0])):
        found = common_lines(own, theirs)
        if sum(sizes[k] for k in found) > copy * total:
            continue
        out.update(found)
        near -= 1
        if not near:
            break
    return sorted(out)


_SHAPE = "host string, path string, h long, hashes array<long>, sizes array<int>"


def _placed(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with host, path and h, the hash of the html."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"), path.alias("path"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("h"))


def _keys(placed: DataFrame) -> DataFrame:
    """host, path and h of each row, and the hashes and words of its lines."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes, sizes = [], []
                for page in part.column(3).to_pylist():
                    own = [t for t, _ in lines(page)]
                    hashes.append([xxhash.xxh64_intdigest(t) - (1 << 63) for t in own])
                    sizes.append([t.count(" ") + 1 for t in own])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["host", "path", "h", "hashes", "sizes"])

    return placed.select("host", "path", "h", "html").mapInArrow(rows, _SHAPE)


def shared(placed: DataFrame, reach: int = REACH, run: int = 512) -> DataFrame:
    """(host, h, gone): the places of the lines that the neighbours of each page share; pages without any are left out."""
    # Pages of a host with equal html are one, at their least path.
    least = _keys(placed).groupBy("host", "h").agg(F.min(F.struct("path", "hashes", "sizes")).alias("least"))
    own = written(least.select("host", "least.path", "h", "least.hashes", "least.sizes"), "least")
    # A row's id holds its range and its place there, so that numbering needs no shuffle of its own.
    own = own.repartitionByRange("host", "path", "h").sortWithinPartitions("host", "path", "h").withColumn("id", F.monotonically_increasing_id())
    own = written(own.withColumns({"seg": F.shiftright("id", 33), "place": F.col("id").bitwiseAND((1 << 33) - 1)}).drop("id"), "pages")
    ahead = Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    begins = own.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).select("seg", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    own = own.join(F.broadcast(begins), "seg").withColumn("g", F.col("begin") + F.col("place"))  # a row for each shuffle partition
    first, last = F.floor((F.col("g") - reach) / run), F.floor((F.col("g") + reach) / run)
    rows = own.withColumn("run", F.explode(F.sequence(first, last))).withColumn("own", F.floor(F.col("g") / run) == F.col("run"))
    rows = rows.repartition("run").sortWithinPartitions("run", "g").select("run", "own", "host", "path", "h", "hashes", "sizes")

    def found(group: list[tuple], at: int, low: int) -> tuple | None:
        """The result for page ``at`` of a run of pages of one host; its neighbours lie from ``low`` on."""
        own_, host, path, h, hashes, sizes = group[at]
        if not own_ or not hashes:
            return None
        order = [k for d in range(1, reach + 1) for k in (at - d, at + d) if low <= k < len(group)]
        gone = shared_places(hashes, sizes, path, [(group[k][2], group[k][4]) for k in order])
        return (host, h, gone) if gone else None

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        mark, done = None, 0
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*(x for x in out if x), strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["host", "h", "gone"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if (r["run"], r["host"]) != mark:
                        out += [found(group, k, max(0, k - reach)) for k in range(done, len(group))]
                        group, done, mark = [], 0, (r["run"], r["host"])
                    group.append((r["own"], r["host"], r["path"], r["h"], r["hashes"], r["sizes"]))
                    if len(group) > done + reach:
                        out.append(found(group, done, max(0, done - reach)))
                        done += 1
                        if done > 2 * reach:  # pages that no page to come can look back at
                            del group[: done - reach]
                            done = reach
                yield packed()
        out += [found(group, k, max(0, k - reach)) for k in range(done, len(group))]
        yield packed()

    return rows.mapInArrow(diff, "host string, h long, gone array<int>")


def main_text(own: list[tuple[str, int]], gone: list[int] | None) -> tuple[str, int, int]:
    """The lines that stay, joined by one space, and the numbers of lines that differencing and that markup removed."""
    gone_ = set(gone or ())
    stay, shared_, marked = [], 0, 0
    for k, (text, marks) in enumerate(own):
        if k in gone_ and marks != ARTICLE:
            shared_ += 1
        elif marks & OTHER:
            marked += 1
        else:
            stay.append(text)
    return " ".join(stay), shared_, marked


def held(own: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """The marks of a page's lines, a byte each, and the compressed lines that may stay: no line holds a line feed."""
    return bytes(m for _, m in own), zlib.compress("\n".join(t for t, m in own if not m & OTHER).encode(), 1)


def read_back(marks: bytes, texts: bytes) -> list[tuple[str, int]]:
    """What :func:`held` was given, with an empty text for each line whose markup removes it whatever neighbours share."""
    left = iter(zlib.decompress(texts).decode().split("\n"))
    return [("" if m & OTHER else next(left), m) for m in marks]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared and n_marked (lines that differencing and that markup removed) of every row of ``pages`` (page_id, url, html)."""
    placed = _placed(pages)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = [held(lines(page)) for page in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array([x[k] for x in both], pa.binary()) for k in (0, 1))], ["page_id", "url", "host", "h", "marks", "texts"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [main_text(read_back(m, t), g) for m, t, g in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                counts = [pa.array(x, pa.int64()) for x in ([len(t) for t, _, _ in own], [x for _, x, _ in own], [x for _, _, x in own])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _, _ in own], pa.string()), *counts], ["page_id", "url", "text", "n_chars", "n_shared", "n_marked"])

    rows = placed.select("page_id", "url", "host", "h", "html").mapInArrow(parsed, "page_id long, url string, host string, h long, marks binary, texts binary")
    rows = rows.join(shared(placed), ["host", "h"], "left").select("page_id", "url", "marks", "texts", "gone")
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long, n_shared long, n_marked long")
