"""Main text of HTML pages by nearest-URL page differencing.

A page becomes lines: one for each block of visible text, in page order. Pages are paired with
the nearest page of their host by URL path (the neighbour in path order with the longer
common prefix). The lines of a pair are aligned by longest common subsequence and shared
lines are deleted. Markup has the last word in two ways, since the method alone can't give
right results: lines in navigation, headers, footers, sidebars, notices, adverts, forms and
comments go whether shared or not, and lines inside an article or main element stay even if
the site repeats them. Of articles, main and the rest without shared lines, the one with most text is kept; so
a teaser's article doesn't stand for its page. Lines outside an article or main that are mostly links go.

Pairs are sought in the whole host: its distinct paths are dealt out in order, by ranges, and the
paths at a cut know their neighbour beyond it, so no task gathers a host and no size changes a
result. Of pages of one path the least id (and text) is the one that others meet. Two pages of equal
path, or of which nearly all lines agree, are the same page twice and don't delete each other's lines.

A null or empty page gives an empty text. A page with a null or odd URL is not paired. Unclosed
elements end with what encloses them; unclosed scripts, styles and titles run to the end, as they do in browsers. Ids may be null or repeated: one result row for each
row; equal rows give equal results. Other columns are not read. An empty table gives an empty
result. Pages are whole, of any length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

#: Share of agreeing lines from which two pages are one page.
SAME = 0.9

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
#: Elements that go with all they hold, if they end.
WHOLE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("noscript", "template", "svg", "iframe", "object")}
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("nav header footer aside form head select textarea button menu dialog datalist audio video canvas map".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of class and id attributes that mark what is not the article.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar sidenav nav navbar navigation menu submenu breadcrumb breadcrumbs footer masthead topbar cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations teaser teasers pagination pager "
    "widget widgets toolbar login search searchform disclaimer skip hidden".split()
)
COMMENTS = set("comment comments commentlist disqus respond response responses reply replies discussion feedback reactions".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _marked(tag: str, attributes: str) -> str:
    """'' for content, else what kind of non-content the element is."""
    if tag in SKIPPED:
        return tag
    if not attributes or attributes.isspace():
        return ""
    kind = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(value.strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "role" and value in ROLES:
            kind = kind or "marked"
        elif name in ("class", "id"):
            words = set(re.split(r"[^a-z]+", value))
            if words & COMMENTS:
                kind = "comments"
            elif words & MARKS and tag not in ("html", "body", "main", "article"):
                kind = kind or "marked"
            elif "header" in words and tag == "div":
                kind = kind or "header"
    return kind if tag not in ("html", "body") else ""


def lines_of(html: str | None) -> list[tuple[str, str]]:
    """(line, place): place is 'article' and its number on the page, 'main', 'open', 'links' or 'off'. Linear in the page."""
    out: list[tuple[str, str]] = []
    articles = 0
    stack: list[tuple[str, str]] = []  # open elements with an end of their own: (tag, kind)
    off = 0
    containers = {"article": 0, "main": 0}
    held: list[str] = []
    linked = in_link = 0
    heading = ""
    seen_content = False

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(held)).split()) if held else ""
        if text:
            header = off == 1 and stack_kind() == "header" and containers["article"] and heading
            place = "off" if off and not header else f"article {articles}" if containers["article"] else "main" if containers["main"] else "links" if 2 * linked >= len(text) else "open"
            out.append((text, place))
        held.clear()
        linked = 0

    def stack_kind() -> str:
        return next((k for _, k in reversed(stack) if k in SKIPPED or k in ("marked", "comments")), "")

    def pop(n: int) -> None:
        nonlocal off
        while len(stack) > n:
            tag, kind = stack.pop()
            if kind in containers:
                containers[kind] -= 1
            elif kind:
                off -= 1

    at = 0
    html = html or ""
    last = html.rfind(">") + 1  # no tag ends beyond
    unended: set[str] = set()
    while m := TOKEN.search(html, at, last):
        if m.start() > at:
            piece = html[at : m.start()]
            held.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        if at == last and (m[1] and not re.search(rf"</{m[1]}\s*>$", m[0], re.I) or m[0].startswith("<!--") and not m[0].endswith("-->")):
            at = len(html)  # a script or comment that doesn't end
        tag, attributes = (m["tag"] or "").lower(), m["attributes"] or ""
        if not tag:
            continue
        if tag in WHOLE and not m["end"] and tag not in unended:
            if end := WHOLE[tag].search(html, at):
                at = end.end()
                continue
            unended.add(tag)  # nor does any later one
        if m["end"]:
            if tag in BLOCKS:
                flush()
            elif tag in ("td", "th"):
                held.append(" ")
            if tag in HEADINGS:
                heading = ""
            if tag == "a":
                in_link = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    pop(i)
                    break
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th", "img", "input"):
            held.append(" ")
        if tag in HEADINGS:
            heading = tag
        if tag == "a":
            in_link = 1
        if tag in VOID:
            continue
        kind = _marked(tag, attributes)
        if tag in ("article", "main") and kind != "comments" or "main" in attributes and re.search(r"\brole\s*=\s*[\"']?main\b", attributes):
            flush()
            if off and not seen_content and not any(k in ("comments", "aside", "footer") for _, k in stack):
                for i, (_, k) in enumerate(stack):  # what looked like a frame holds the content
                    if k and k not in containers:
                        stack[i] = (stack[i][0], "")
                off = 0
            if not off:
                seen_content = True
            kind = kind or ("article" if tag == "article" else "main")
            if kind in containers:
                articles += kind == "article" and not containers["article"]
                containers[kind] += 1
            else:
                off += 1
            stack.append((tag, kind))
        elif kind:
            flush()
            if tag == "body" or (tag in ("nav", "header", "footer") and stack and stack[-1][0] == "head"):
                pop(len(stack) - 1 if stack else 0)
            off += 1
            stack.append((tag, kind))
        elif tag == "body":
            flush()
            while stack and stack[-1][0] == "head":
                pop(len(stack) - 1)
        elif stack and any(t == tag for t, _ in stack):
            stack.append((tag, ""))
    if at < len(html):
        tail = html[at:].partition("<!--")[0]
        cut = tail.rfind("<")
        held.append(tail if cut < 0 or not re.match(r"<[!/a-zA-Z]", tail[cut:]) else tail[:cut])
    flush()
    return out


def main_lines(lines: list[tuple[str, str]], shared: set[int]) -> list[str]:
    """The kept lines. shared: numbers of lines that the nearest page has too.

    The container with most text of its own has the main text: an article, main without its articles, or what is open
    without lines that the nearest page shares. Articles of a third of the largest stay with it; smaller ones are teasers.
    """
    size: dict[str, int] = {}
    for i, (text, place) in enumerate(lines):
        if place not in ("off", "links") and (place != "open" or i not in shared):
            size[place] = size.get(place, 0) + len(text)
    if not size:
        return []
    best = max(size, key=lambda p: (size[p], p.startswith("article"), p == "main"))
    kept = {p for p in size if p.startswith("article") and 3 * size[p] >= size[best]} if best.startswith("article") else {best}
    return [text for i, (text, place) in enumerate(lines) if place in kept and (place != "open" or i not in shared)]


def common_subsequence(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence of a and b (Hunt and Szymanski)."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = set(range(low)) | set(range(len(a) - high, len(a)))
    where: dict[int, list[int]] = {}
    for j in range(len(b) - high - 1, low - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple | None] = []
    for i in range(low, len(a) - high):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _choose(batches):
    """(host, path, other): the neighbour in path order with the longer common prefix."""
    for batch in batches:
        others = []
        for p, l, r in zip(*(batch.column(c).to_pylist() for c in ("path", "before", "after")), strict=True):
            others.append(l if r is None else r if l is None else l if _prefix(l, p) >= _prefix(r, p) else r)
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), pa.array(others, pa.string())], names=["host", "path", "other"])


def nearest(paths: DataFrame) -> DataFrame:
    """(host, path, other): the nearest other path of its host for each distinct path that has one. paths: (host, path)."""
    dealt = C.cut(paths.distinct().repartitionByRange("host", "path").withColumn("part", F.spark_partition_id()))
    ends = sorted(dealt.groupBy("part").agg(F.min(F.struct("host", "path")).alias("low"), F.max(F.struct("host", "path")).alias("high")).collect())  # a row for each part
    beyond = [(r["part"], *(ends[i - 1]["high"] if i else (None, None)), *(ends[i + 1]["low"] if i + 1 < len(ends) else (None, None))) for i, r in enumerate(ends)]
    beyond = F.broadcast(dealt.sparkSession.createDataFrame(beyond, "part int, host_before string, path_before string, host_after string, path_after string"))
    order = W.partitionBy("part").orderBy("host", "path")
    known = dealt.select("*", *(f(c).over(order).alias(f"{n}_{c}") for f, n in ((F.lag, "lag"), (F.lead, "lead")) for c in ("host", "path"))).join(beyond, "part")
    sides = []
    for near, far in (("lag", "before"), ("lead", "after")):
        inside = F.col(f"{near}_host").isNotNull()
        host, path = (F.when(inside, F.col(f"{near}_{c}")).otherwise(F.col(f"{c}_{far}")) for c in ("host", "path"))
        sides.append(F.when(host == F.col("host"), path).alias(far))
    return known.select("host", "path", *sides).where("before is not null or after is not null").mapInArrow(_choose, "host string, path string, other string")


def _keys(lines: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x in lines]


def _hasher(batches):
    for batch in batches:
        keys = [_keys([t for t, _ in lines_of(html)]) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "path", "id")), pa.array(keys, pa.list_(pa.int64()))], names=["host", "path", "id", "keys"])


def _reader(batches):
    for batch in batches:
        texts, places = [], []
        for html in batch.column("html").to_pylist():
            lines = lines_of(html)
            texts.append([t for t, _ in lines])
            places.append([p for _, p in lines])
        kept = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.string()))], names=[*kept, "lines", "places"])


def _differ(batches):
    for batch in batches:
        texts = []
        for lines, places, other in zip(*(batch.column(c).to_pylist() for c in ("lines", "places", "other_keys")), strict=True):
            keys = _keys(lines)
            shared = common_subsequence(keys, other) if other is not None else set()
            if keys and len(shared) >= SAME * max(len(keys), len(other or ())):
                shared = set()
            texts.append("\n".join(main_lines(list(zip(lines, places, strict=True)), shared)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    path = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://[^/?#]*(/[^?#]*)?", 1), F.lit(""))
    rows = C.small_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")))
    rows = rows.withColumn("path", path)
    kind = rows.schema["id"].dataType.simpleString()
    hosted = rows.where("host <> ''")
    near = C.cut(nearest(hosted.select("host", "path")))
    # Pages are read twice, which spares writing all lines once more.
    hashed = hosted.select("host", "path", "id", "html").mapInArrow(_hasher, f"host string, path string, id {kind}, keys array<long>")
    met = hashed.groupBy("host", "path").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "keys")).alias("least"))
    others = near.join(met.select("host", F.col("path").alias("other"), F.col("least.keys").alias("other_keys")), ["host", "other"]).select("host", "path", "other_keys")
    read = rows.mapInArrow(_reader, f"id {kind}, url string, host string, path string, lines array<string>, places array<string>")
    out = read.join(others, ["host", "path"], "left").select("id", "url", "lines", "places", "other_keys").mapInArrow(_differ, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
