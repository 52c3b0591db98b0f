"""Main text of web pages, by element marks and nearest-URL page differencing.

Pages are sorted by host, URL path and URL over ranges of URLs, so that a host of any size is dealt to many tasks, and each page is
paired with that neighbour of its host whose path shares the longer beginning (the one before it, if equal). The pages at the ends
of a range are sent to the next range too, so that pairs don't depend on how many ranges there are. The text lines of
the two are aligned by their longest common subsequence, and shared lines are deleted: what a site puts on every page.

Differencing alone can't give right results: menus, adverts and footers may differ on every page of a host, and articles of one
host may share whole passages. So elements that mark a line as no part of the article drop it first, lines inside a marked
article stay, and differencing decides on the lines that no element marks. Where a
page has no pair, a marked article stays alone.

Null html gives an empty text, a page with a null URL has no pair. Repeated rows give repeated results: pages of one URL are no
pair, and all have the same neighbours, the last page of the URL before and the first of the one after. An empty table gives an
empty result.
"""

from __future__ import annotations

import html
import os
import pickle
import re
import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr caption blockquote pre section article main header footer nav aside figure figcaption hr form fieldset address details summary body html head hgroup dialog menu".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements whose lines are never the article's; a header is, inside an article, its own head.
DROPPED = frozenset("nav footer aside form head button menu dialog".split())
MAIN = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words in class or id that mark what isn't the article: parts of names outside a marked article, whole names inside, where
#: `share-price` or `related-work` may well be its own.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar notice notices cookie cookies consent popup modal newsletter subscribe share sharing social related comment comments reply replies disqus".split())
#: Those that mark an article element as a reader's remark.
REMARKS = frozenset(["comment", "comments", "reply"])
CLASSES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def boilerplate(name: str, attrs: str, in_main: bool) -> bool:
    if name in DROPPED or name == "header" and not in_main:
        return True
    if not attrs or name in ("body", "html"):
        return False
    for m in CLASSES.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            words = value.split() if in_main or name in MAIN else re.split(r"[^a-z0-9]+", value)
            if not (REMARKS if name in MAIN else MARKS).isdisjoint(words):
                return True
    return False


def lines(page: str, whole: bool = False) -> list[tuple[str, bool]]:
    """The blocks that no element drops (whole: all of them, as if no element marked any) and whether each lies in a marked article."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, in an article
    dropped = in_main = False
    at = 0

    def flush() -> None:
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                out.append((line, in_main))
            parts.clear()

    for m in TAG.finditer(page):
        if m.start() > at and not dropped:
            parts.append(page[at : m.start()])
        at = m.end()
        if m["raw"] or not m["name"]:
            continue
        name = m["name"].lower()
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th", "option", "label"):
            parts.append(" ")
        if name in VOID:
            continue
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                del stack[k:]
                dropped, in_main = stack[-1][1:] if stack else (False, False)
        elif name in BLOCKS or name in DROPPED or m["attrs"]:
            if m["attrs"].endswith("/"):
                continue
            if stack and name in ("p", "li") and stack[-1][0] == name:
                stack.pop()
                dropped, in_main = stack[-1][1:] if stack else (False, False)
            dropped = not whole and (dropped or boilerplate(name, m["attrs"], in_main))
            in_main = not whole and (in_main or name in MAIN or "main" in m["attrs"] and bool(re.search(r"""role\s*=\s*["']?main\b""", m["attrs"])))
            stack.append((name, dropped, in_main))
    if not dropped:
        parts.append(page[at:])
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b."""
    where: dict[str, list[int]] = {}
    mine = set(a)
    for j, x in enumerate(b):
        if x in mine:
            where.setdefault(x, []).append(j)
    ends: list[int] = []  # least last position in b of a common subsequence of each length
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def main_text(mine: list[tuple[str, bool]], other: list[tuple[str, bool]] | None) -> str:
    """The lines of a marked article, and those that no element marks and other lacks; without other, a marked article alone."""
    marked = any(m for _, m in mine)
    shared = common_lines([x for x, _ in mine], [x for x, _ in other]) if other else set()
    return "\n".join(x for i, (x, m) in enumerate(mine) if m or (other is not None or not marked) and i not in shared)


def _near(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


#: Keys looked at for each range of URLs, and bytes of a URL's pages held in memory while the next URL is awaited.
KEYS, HELD = 20, 16 << 20


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    """rows with bucket, one of n ranges of (host, path, url), and own; a page at the end of a range is also, not as its own, in the
    range of the host's next URL on that side. Pages without a URL have no neighbours and go anywhere."""
    key = F.struct("host", "path", "url")
    some = rows.where("url is not null").select("host", "path", "url").distinct().orderBy(F.xxhash64("url"), "host", "path", "url").limit(KEYS * n).collect()
    keys = sorted(map(tuple, some))
    bounds = sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []

    @F.arrow_udf("int")
    def of_key(host: pa.Array, path: pa.Array, url: pa.Array) -> pa.Array:
        return pa.array([None if k[2] is None else bisect_right(bounds, k) for k in zip(*(c.to_pylist() for c in (host, path, url)))], pa.int32())

    anywhere = F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(n)).cast("int")
    rows = rows.withColumn("bucket", F.coalesce(of_key("host", "path", "url"), anywhere))
    edges = rows.where("url is not null").groupBy("bucket").agg(F.min(key).alias("first"), F.max(key).alias("last")).orderBy("bucket").collect()
    also: dict[str, set[int]] = {}
    for a, b in zip(edges, edges[1:]):
        if a["last"].host == b["first"].host:
            also.setdefault(a["last"].url, set()).add(b.bucket)
            also.setdefault(b["first"].url, set()).add(a.bucket)
    if not also:
        return rows.withColumn("own", F.lit(True))
    copies = rows.sparkSession.createDataFrame([(u, sorted(x)) for u, x in also.items()], "url string, also array<int>")
    return rows.join(F.broadcast(copies), "url", "left").withColumn("home", F.col("bucket")).withColumn("bucket", F.explode(F.concat(F.array("home"), F.coalesce("also", F.array().cast("array<int>"))))).withColumn("own", F.col("bucket") == F.col("home"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", marks: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page. Without marks, differencing alone decides on every line."""
    url = F.col(f"`{url_col}`").cast("string")
    site = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.lower(site).alias("host"), path.alias("path"), F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                for bucket, own, host, path, page, url, source in zip(*(c.to_pylist() for c in batch.columns)):
                    yield (bucket, host), url, path, own, page, lines(source, not marks)

        def result(before: tuple | None, here: tuple, after: tuple | None) -> tuple:
            near = [x for x in (before, after) if x and x[0] == here[0]]
            other = max(near, key=lambda x: _near(x[2], here[2])) if near else None
            text = main_text(here[5], other and other[5])
            return here[4], here[1], text, len(text)

        def results() -> Iterator[tuple]:
            before = last = None  # last pages of the URL before and of this one
            with tempfile.SpooledTemporaryFile(HELD) as held:  # this URL's own pages

                def awaited(after: tuple | None) -> Iterator[tuple]:
                    held.seek(0)
                    while True:
                        try:
                            here = pickle.load(held)
                        except EOFError:
                            break
                        yield result(before, here, after)
                    held.seek(0)
                    held.truncate()

                for here in stream():
                    if here[1] is None:
                        yield result(None, here, None)
                        continue
                    if last and (last[0], last[1]) != (here[0], here[1]):
                        yield from awaited(here)
                        before = last
                    if here[3]:
                        pickle.dump(here, held)
                    last = here
                yield from awaited(None)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "url", "text", "n_chars"])

        out: list[tuple] = []
        for row in results():
            out.append(row)
            if len(out) >= 500:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    ranged = _ranged(rows, n).select("bucket", "own", "host", "path", "page_id", "url", "html")
    order = ["bucket", "host", "path", "url", "page_id", F.xxhash64("html")]
    return ranged.repartitionById(n, "bucket").sortWithinPartitions(*order).mapInArrow(run, "page_id long, url string, text string, n_chars long")
