"""Main text of web pages by markup rules and nearest-URL page differencing.

A page becomes lines, one for each block of text, marked as article (inside article or main), open (no
such element on the page) or furniture (menus, headers, footers, asides, adverts, notices, forms,
comments, by element, role, class or id). Pages of a host are put in order of their URL paths; of its
two neighbours, each page is compared with the one that shares the longer start of the path. Their
lines are aligned by longest common subsequence, and shared lines go, save those that the markup
names as the article's own: a story that stands on two pages is not furniture.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafpress.llm.common import persist, shuffle_partitions

ARTICLE, OPEN, FURNITURE = 0, 1, 2

# A tag whose quotes don't pair off ends at its first ">".
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "annotation", "annotation-xml", "object", "select"}
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in _RAW}
_VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_SKIPPED = {"nav", "aside", "footer", "form", "button", "head", "menu", "dialog"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "sidebar sidenav rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs masthead topbar header footer comment comments disqus replies respond share sharing social related "
    "recommended recommendations teaser teasers pagination pager toolbar login searchbox copyright disclaimer".split()
)
#: Inside an article, names of containers (div and the like) that never hold its text, each a class or id by itself or with a
#: word like "box" behind it; and names that make an article no article.
_STRONG = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "comment", "comments", "disqus", "share", "sharing", "social", "newsletter", "subscribe", "cookie", "cookies", "consent", "sidebar", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "navigation", "menu", "nav", "teaser"}
_BOXES = {"area", "bar", "block", "box", "buttons", "container", "form", "list", "notice", "section", "links", "wrap", "wrapper"}
_FOREIGN = {"comment", "comments", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "teaser"}
_CONTAINERS = {"div", "section", "aside", "ul", "ol", "ins", "span", "figure", "details"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _furniture(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element with these attributes is furniture; inside: within an article, where only plain cases count."""
    if tag in _SKIPPED or tag == "header" and not inside:
        return True
    if not attributes or attributes.isspace() or tag in ("html", "body", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if tag == "article":
                if _FOREIGN & set(value.lower().split()):
                    return True
            elif inside:
                if tag in _CONTAINERS and any(_plain(x) for x in value.split()):
                    return True
            elif tag not in _HEADINGS and _NAMES & set(_SPLIT.split(_CAMEL.sub(" ", value).lower())):
                return True
        elif name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _plain(name: str) -> bool:
    own = [x for x in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if x]
    return bool(own) and own[0] in _STRONG and all(x in _STRONG or x in _BOXES for x in own[1:])


#: Start tags that end an open element of the same kind, with the element that the search for it stays inside of.
_REPEATS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}


def _implied_ends(stack: list[tuple[str, bool, bool]], tag: str) -> None:
    """A block ends an open paragraph; an item, row or cell the one before it."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == "p":
            del stack[i:]
            break
    kinds, around = _REPEATS.get(tag, ((), ()))
    for i in range(len(stack) - 1, -1, -1) if kinds else ():
        if stack[i][0] in around:
            break
        if stack[i][0] in kinds:
            del stack[i:]
            break


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, mark) of every block in page order; character references decoded, white space collapsed."""
    lines: list[tuple[str, int]] = []
    own: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, furniture, article, of it or an element around it
    seen = False

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def close() -> None:
        if own:
            text = " ".join(html.unescape("".join(own)).split())
            own.clear()
            if text:
                skip, article = state()
                lines.append((text, FURNITURE if skip else ARTICLE if article else OPEN))

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        ends, tag, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if tag is None:
            if not m.group().startswith("<") or m.group() == "<":
                own.append(m.group())
            continue
        tag = tag.lower()
        if ends:
            if tag in _BLOCKS:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close()
                    del stack[i:]
                    break
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.start() if end else len(page)
                gt = page.find(">", at)
                at = len(page) if gt < 0 else gt + 1
            continue
        if tag in _BLOCKS:
            close()
            _implied_ends(stack, tag)
        elif tag == "br":
            own.append(" ")
        if tag in _VOID:
            continue
        skip, article = state()
        odd = _furniture(tag, attributes, article)
        starts = tag in ("article", "main") or "main" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes) is not None
        if odd or starts or tag in _BLOCKS and tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            if odd or starts:
                close()
            stack.append((tag, skip or odd, article or starts))
            seen |= starts and not (skip or odd)
    close()
    return [(t, FURNITURE if k == OPEN and seen else k) for t, k in lines]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b: rows of bits, then a walk back."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    head, tail = list(range(lo)), list(range(len(a) - hi, len(a)))
    common = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    at = [i for i in range(lo, len(a) - hi) if a[i] in common]
    y = [x for x in b[lo : len(b) - hi] if x in common]
    if not at:
        return head + tail
    where: dict[int, int] = {}
    for j, x in enumerate(y):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(y)) - 1
    v, rows = full, []
    for i in at:
        u = v & where[a[i]]
        v = (v + u | v - u) & full
        rows.append(v)
    # A zero bit j of a row means that the subsequence grows at place j.
    middle, j = [], len(y)
    for i in range(len(at) - 1, -1, -1):
        length = j - (rows[i] & ((1 << j) - 1)).bit_count()
        before = j - (rows[i - 1] & ((1 << j) - 1)).bit_count() if i else 0
        if length > before:
            middle.append(at[i])
            # The last place in y, before j, with which this line makes the length.
            low = where[a[at[i]]] & ((1 << j) - 1)
            while True:
                k = low.bit_length() - 1
                if (k - ((rows[i - 1] & ((1 << k) - 1)).bit_count()) if i else 0) == length - 1:
                    j = k
                    break
                low ^= 1 << k
    return head + middle[::-1] + tail


def _row_key(page_id: int | None, url: str | None, page: str | None) -> bytes:
    """Names a row by its content, so that it is the same in both passes over the pages."""
    return hashlib.blake2b(repr((page_id, url, page)).encode(errors="replace"), digest_size=16).digest()


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first pass: line hashes and marks of each page, without any text."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            uid, hosts, paths, hashes, marks = [], [], [], [], []
            for page_id, url, page in zip(*(c.to_pylist() for c in part.columns)):
                try:
                    u = urlsplit(url or "")
                    hosts.append((u.hostname or "").lower())
                    paths.append(u.path or "/")
                except ValueError:
                    hosts.append("")
                    paths.append(url)
                lines = page_lines(page or "")
                uid.append(_row_key(page_id, url, page))
                hashes.append([int.from_bytes(hashlib.blake2b(t.encode(errors="replace"), digest_size=8).digest(), "little", signed=True) for t, _ in lines])
                marks.append(bytes(k for _, k in lines))
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.binary()), pa.array(hosts), pa.array(paths), pa.array(hashes, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["uid", "host", "path", "hashes", "marks"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second pass: the lines that may stay, compressed for their way to the join."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            uid, packed = [], []
            for page_id, url, page in zip(*(c.to_pylist() for c in part.columns)):
                uid.append(_row_key(page_id, url, page))
                # A line holds no line feed, and never starts with one, so the first character tells what is kept.
                packed.append(zlib.compress("\n".join("-" if k == FURNITURE else "+" + t for t, k in page_lines(page or "")).encode(errors="replace"), 6))
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.binary()), part.column(0), part.column(1), pa.array(packed, pa.binary())], names=["uid", "page_id", "url", "packed"])


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for packed, drop in zip(batch.column("packed").to_pylist(), batch.column("drop").to_pylist()):
            gone = set(drop or ())
            texts.append("\n\n".join(x[1:] for i, x in enumerate(zlib.decompress(packed).decode().split("\n")) if x.startswith("+") and i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("shared_lines")], names=["page_id", "url", "text", "n_chars", "shared_lines"])


def _start(a: str, b: str | None) -> int:
    if b is None:
        return -1
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid, shared, drop = [], [], []
        for r in batch.to_pylist():
            before = r["p_hashes"] if r["p_host"] == r["host"] else None
            after = r["n_hashes"] if r["n_host"] == r["host"] else None
            if before is not None and after is not None:
                other = after if _start(r["path"], r["n_path"]) > _start(r["path"], r["p_path"]) else before
            else:
                other = before if before is not None else after
            same = shared_lines(r["hashes"], other) if other else []
            mine = [i for i in same if r["marks"][i] != ARTICLE]
            uid.append(r["uid"])
            shared.append(len(mine))
            drop.append([i for i in mine if r["marks"][i] == OPEN] or None)
        yield pa.RecordBatch.from_arrays([pa.array(uid, pa.binary()), pa.array(shared, pa.int64()), pa.array(drop, pa.list_(pa.int32()))], names=["uid", "shared_lines", "drop"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, shared_lines (lines outside the article that the nearest page has too).

    The text joins the kept blocks by an empty line. One row per input row, repeated and null ids
    too; a null or empty page, or one without text, gives an empty text. A null or broken URL counts as
    host "" with the URL as path. A page alone on its host has no page to differ from; equal rows are
    one page. Only line hashes are put in URL order, and a hot host is spread over as many tasks as it
    fills. Pages are parsed twice, which costs less than to keep their texts between.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    order_by = ["host", "path", "uid"]
    keys = base.mapInArrow(_outline, "uid binary, host string, path string, hashes array<long>, marks binary").withColumn("path", F.coalesce("path", F.lit("")))
    # Equal rows meet in one range, where one of them is enough.
    keys = keys.repartitionByRange(shuffle_partitions(spark), *order_by).dropDuplicates(order_by).sortWithinPartitions(*order_by)
    keys = persist(keys.withColumn("pid", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "ordered")
    beside = F.struct("host", "path", "hashes")
    # Ranges hold neighbours together; the last row of one and the first of the next meet in a table of a row a range.
    ends = keys.groupBy("pid").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    edge = keys.select("pos", beside.alias("row"))
    order = Window.orderBy("pid")
    ends = ends.select("pid", F.lag("hi").over(order).alias("p_pos"), F.lead("lo").over(order).alias("n_pos"))
    ends = ends.join(edge.select(F.col("pos").alias("p_pos"), F.col("row").alias("p_edge")), "p_pos", "left").join(edge.select(F.col("pos").alias("n_pos"), F.col("row").alias("n_edge")), "n_pos", "left")
    own = Window.partitionBy("pid").orderBy("pos")
    rows = keys.withColumn("p", F.lag(beside).over(own)).withColumn("n", F.lead(beside).over(own)).join(ends, "pid")
    p, n = F.coalesce("p", "p_edge"), F.coalesce("n", "n_edge")
    rows = rows.select("uid", "host", "path", "hashes", "marks", *[x[c].alias(f"{s}_{c}") for s, x in (("p", p), ("n", n)) for c in ("host", "path", "hashes")])
    found = rows.mapInArrow(_difference, "uid binary, shared_lines long, drop array<int>")
    packed = base.mapInArrow(_texts, "uid binary, page_id long, url string, packed binary")
    return packed.join(found, "uid").mapInArrow(_join_lines, "page_id long, url string, text string, n_chars long, shared_lines long")
