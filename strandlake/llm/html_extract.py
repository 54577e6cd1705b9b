"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path, so that the nearest path is next to a page. A page becomes a list of block
lines. Neighbours in that order of which one repeats at least ALIKE of the other's characters form a run, and each
page of a run is compared with the nearest pages outside it, the last of the run before and the first of the run
after; a host of one run has only its own pages to compare, the nearest of different text. The lines of the two pages
are aligned by longest common subsequence, and lines that both have, in the same order, are the site's template and
are deleted.

Structure guides the alignment. Elements that never hold main text (navigation, header, footer, aside, form,
script and the like, or classes and ids that say so) are cut before it. Where a page declares its main part
(main, article or the equivalent role), lines outside it are cut too. Lines of links inside it are deleted as any
other line; prose inside it, which two articles may quote from each other, only if all of the WITNESSES nearest runs
(fewer in a smaller host, two at least) have it, of which none is nearly equal to the page or to another.

Neighbours are found inside ranges of (host, path); a range also sees the EDGE rows on the other side of its borders.
A border stands only where the EDGE rows on both its sides hold EDGE_RUNS runs, enough for every page beside it, so a
hot host is split without changing any result.

Defined cases: null and empty html give an empty text; a null url belongs to the empty host; repeated rows are of one
run, so that an exact copy does not delete the whole page; rows of one url go by page_id and the html's hash; other
columns are not looked at, whatever their names; an empty table gives no rows; a very long page is read and aligned whole.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import islice, zip_longest
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.common import written
from strandlake.llm.url_filter import host_of, path_of

# HTML element names by what they hold.
NEVER = frozenset("aside audio button canvas datalist dialog footer form head iframe menu nav noscript object script select style svg template textarea title video".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: An open p is closed by these; an open li, td and so on by its own kind.
CLOSES_P = BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: A word of a class, id or role that marks what is not main text.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus "
    "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion "
    "related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
INSIDE_NOISE = NOISE - {"header", "masthead"}
MAIN_WORDS = frozenset("articlebody".split())
#: Whole classes of the content itself; headings, and headers inside a main part, are content too.
CONTENT = frozenset("article article-body article-content body content entry entry-content main main-content post post-body post-content story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Pages of one task; ranges are made so that each has about this many.
RANGE_PAGES = 2000
#: Rows seen beyond a border, and the runs they must hold for the border to stand.
EDGE, EDGE_RUNS = 16, 6
#: Share of the longer page's characters that the lines of both make up, from which pages are nearly equal.
ALIKE = 0.9
#: Nearest runs that must all have a line of prose of the main part before it is template.
WITNESSES = 4
#: Borders and ends of ranges are broadcast up to this many rows, joined by a shuffle beyond.
BROADCAST_ROWS = 20_000

#: A line of a page: its text, whether it is in a main part, whether it is mostly links.
Line = tuple[str, bool, bool]

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"[\x20\x09-\x0D\xA0]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def _marks(attrs: str, inside: bool = False) -> tuple[bool, bool, bool]:
    """Whether attributes mark noise, a main part, or hide the element. inside: it stands in a main part."""
    noise = main = hidden = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            whole = set(value.split())
            # a class that names the content itself outweighs a word of another
            noise |= bool(set(re.split(r"[^a-z0-9]+", value)) & (INSIDE_NOISE if inside else NOISE)) and not whole & CONTENT
            main |= name == "role" and value in ("main", "article")
        elif name == "itemprop":
            main |= value in MAIN_WORDS
        elif name == "aria-hidden":
            hidden |= value == "true"
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
    hidden |= bool(re.search(r"(?:^|\s)hidden(?=\s|/|$)", attrs))
    return noise, main, hidden


def lines_of(page: str) -> list[Line]:
    """The page's block lines outside elements that never hold main text: (line, in a main part, mostly links)."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # element, cuts its content, is a main part
    cut = main = link = 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip(" ")
            if text:
                out.append((text, main > 0, 2 * linked > len(text)))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not cut:
            parts.append(text)
            if link:
                linked += len(text)

    def pop() -> None:
        nonlocal cut, main, link
        name, cuts, is_main = stack.pop()
        if name in BLOCK or cuts:
            flush()
        cut -= cuts
        main -= is_main
        link -= name == "a"

    pos, n = 0, len(page)
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            add(page[pos:])
            break
        add(page[pos:at])
        m = _TAG.match(page, at)
        if not m:
            add("<")
            pos = at + 1
            continue
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name == "br":
            add("\n")
            continue
        if name in BLOCK:
            flush()
        if name in CLOSES_P and any(x[0] == "p" for x in stack):
            # an open p ends, with whatever inline elements are open in it, unless a block has come between
            k = max(i for i, x in enumerate(stack) if x[0] == "p")
            if not any(x[0] in BLOCK for x in stack[k + 1 :]):
                while len(stack) > k:
                    pop()
        while name in SAME and stack and stack[-1][0] in SAME[name]:
            pop()
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCK:
            continue
        noise, is_main, hidden = _marks(m[3], bool(main)) if m[3] and m[3].strip() else (False, False, False)
        is_main |= name in ("main", "article")
        # a page's header is noise, an article's own is not
        cuts = name in NEVER or hidden or name == "header" and not main or noise and name not in ("html", "body", "main", "article") and name not in HEADINGS
        if cuts:
            flush()
        if name in RAW:
            end = _END[name].search(page, pos)
            pos = end.start() if end else n
            if not cuts:
                continue
            close = page.find(">", pos)
            pos = close + 1 if close >= 0 else n
            continue
        stack.append((name, cuts, is_main))
        cut += cuts
        main += is_main
        link += name == "a"
    flush()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions of a that a longest common subsequence with b uses."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    kept = {*range(start), *range(len(a) - end, len(a))}
    common = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    # lines of one page alone are in no common subsequence
    x = [(i, s) for i, s in enumerate(a[start : len(a) - end], start) if s in common]
    y = [s for s in b[start : len(b) - end] if s in common]
    return kept | {x[k][0] for k in _longest([t for _, t in x], y)}


def _longest(x: list[str], y: list[str]) -> list[int]:
    """Positions of x in a longest common subsequence with y.

    A row of the table of lengths is a number whose zero bits are the places of y where the length grows. One row
    in about sqrt(len(x)) is kept, and the rows between two of them are made again on the way back.
    """
    if not x or not y:
        return []
    at: dict[str, int] = {}
    for j, t in enumerate(y):
        at[t] = at.get(t, 0) | 1 << j
    full = (1 << len(y)) - 1

    def after(row: int, t: str) -> int:
        u = row & at.get(t, 0)
        return (row + u | row - u) & full

    step = isqrt(len(x)) + 1
    kept, row = [full], full
    for i, t in enumerate(x, 1):
        row = after(row, t)
        if i % step == 0:
            kept.append(row)
    out: list[int] = []
    i, j, base, rows = len(x), len(y), len(x) + 1, []
    length = len(y) - row.bit_count()
    while length:
        if i - 1 < base:
            base = (i - 1) // step * step
            rows = [kept[base // step]]
            for t in x[base : i - 1]:
                rows.append(after(rows[-1], t))
        if x[i - 1] == y[j - 1]:
            out.append(i - 1)
            i, j, length = i - 1, j - 1, length - 1
        elif j - (rows[i - 1 - base] & (1 << j) - 1).bit_count() == length:
            i -= 1
        else:
            j -= 1
    return out


def _compared(lines: list[Line], declared: bool) -> list[str]:
    return [x[0] for x in lines if x[1] or not declared]


def alike(a: list[Line], b: list[Line]) -> bool:
    """Whether two pages are nearly equal: their main parts if both declare one, else all their lines."""
    if a is b:
        return True
    declared = any(m for _, m, _ in a) and any(m for _, m, _ in b)
    x, y = Counter(_compared(a, declared)), Counter(_compared(b, declared))
    both = sum(len(s) * n for s, n in (x & y).items())
    return both >= ALIKE * max(sum(len(s) * n for s, n in c.items()) for c in (x, y))


def _common(texts: list[str], near: list[list[str]]) -> set[int]:
    """Positions of the lines that the page shares with all of the others."""
    found = set(texts).intersection(*near)
    if not found:
        return set()
    return set.intersection(*[shared(texts, x) for x in near])


def main_text(lines: list[Line], near: list[list[Line]], around: list[list[Line]] = ()) -> str:
    """The page's lines less those it shares with the pages it is compared with, by the rules above."""
    declared = any(m for _, m, _ in lines)
    mine = [x for x in lines if x[1] or not declared]
    texts = [x[0] for x in mine]
    gone: set[int] = set()
    for other in near:
        theirs = _compared(other, declared)
        if texts != theirs:
            gone |= shared(texts, theirs)
    prose: set[int] = set()
    if declared:
        seen = [lines]
        for other in around:
            if any(m for _, m, _ in other) and not any(alike(other, x) for x in seen):
                seen.append(other)
        if len(seen) > 2:
            prose = _common(texts, [_compared(x, True) for x in seen[1:]])
    return "\n\n".join(t for i, (t, m, links) in enumerate(mine) if not (i in prose or i in gone and (links or not m)))


def _runs(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows (.., lines last) in runs of nearly equal neighbours; equal neighbours share one list of lines."""
    run: list[tuple] = []
    for r in rows:
        if run and run[-1][:2] == r[:2] and alike(run[-1][-1], r[-1]):
            run.append((*r[:-1], run[-1][-1]) if run[-1][-1] == r[-1] else r)
            continue
        if run:
            yield run
        run = [r]
    if run:
        yield run


def _inside(run: list[tuple]) -> list[list[list[Line]]]:
    """For a host of one run: the nearest pages of different text before and after each."""
    out: list[list[list[Line]]] = []
    for rows in (run, run[::-1]):
        found, other, last = [], None, None
        for r in rows:
            if last is not None and r[-1] is not last:
                other = last
            last = r[-1]
            found.append([] if other is None else [other])
        out.append(found)
    return [a + b for a, b in zip(out[0], out[1][::-1], strict=True)]


def _kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages of whole ranges, sorted; what crosses from batch to batch is the last pages of runs before, and runs ahead."""
    done: list[tuple] = []

    def rows() -> Iterator[tuple]:
        for pdf in batches:
            for r in zip(pdf["_range"], pdf["_host"], pdf["page_id"], pdf["url"], pdf["_guest"], pdf["html"], strict=True):
                yield (*r[:5], lines_of(r[5] or ""))

    def emit(before: list[list[Line]], run: list[tuple], after: list[list[Line]]) -> None:
        near = [*before[:1], *after[:1]]
        # the nearest on both sides in turn; where one side ends, more of the other
        around = [x for pair in zip_longest(before, after) for x in pair if x is not None][:WITNESSES]
        every = [near] * len(run) if near else _inside(run)
        last = text = None
        for r, others in zip(run, every, strict=True):
            if r[4]:
                continue
            # equal neighbours share one list of lines, and so the result
            if text is None or not (near and r[-1] is last):
                last, text = r[-1], main_text(r[-1], others, around)
            done.append((r[2], r[3], text))

    before: deque[tuple] = deque(maxlen=WITNESSES)
    ahead: deque[list[tuple]] = deque()

    def settle() -> None:
        run = ahead.popleft()
        same = lambda r: r[:2] == run[0][:2]
        emit([r[-1] for r in reversed(before) if same(r)], run, [x[0][-1] for x in islice(ahead, WITNESSES) if same(x[0])])
        before.append(run[-1])

    for run in _runs(rows()):
        ahead.append(run)
        if len(ahead) > WITNESSES:
            settle()
        if len(done) >= 1000:
            yield pd.DataFrame(done, columns=["page_id", "url", "text"])
            done.clear()
    while ahead:
        settle()
    if done:
        yield pd.DataFrame(done, columns=["page_id", "url", "text"])


def _ranges(pages: DataFrame, range_pages: int) -> DataFrame:
    """pages (with _key, a struct of host, path, url and page_id) with _no, the number of their range in their host.

    One key in range_pages, chosen by hash, starts a new range; a host's few borders are one row, and its pages
    find their range by counting the borders up to their key.
    """
    starts = pages.select("_key").where(F.pmod(F.xxhash64("_key"), F.lit(range_pages)) == 0).distinct()
    borders = starts.groupBy(F.col("_key.host").alias("_bh")).agg(F.collect_list("_key").alias("_cuts"))
    borders = F.broadcast(borders) if starts.count() <= BROADCAST_ROWS else borders
    found = pages.join(borders, F.col("_key.host") == F.col("_bh"), "left")
    no = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))).otherwise(0)
    return found.withColumn("_no", no).drop("_bh", "_cuts")


def _edges(pages: DataFrame) -> DataFrame:
    """The first and the last EDGE rows of each range, with _head: whether they are its first."""
    def rows(head: bool) -> DataFrame:
        key = F.col("_key").asc() if head else F.col("_key").desc()
        row = F.row_number().over(W.partitionBy("_key.host", "_no").orderBy(key))
        return pages.withColumn("_row", row).where(F.col("_row") <= EDGE).drop("_row").withColumn("_head", F.lit(head))

    return rows(True).unionByName(rows(False))


def _enough(pdf: pd.DataFrame) -> pd.DataFrame:
    """(_eh, _en, _first, _last) of one range: whether its first and its last rows hold EDGE_RUNS runs."""
    held = []
    for head in (True, False):
        found = pdf[pdf["_head"] == head].sort_values("_order", kind="stable")
        held.append(sum(1 for _ in _runs((None, None, lines_of(x or "")) for x in found["html"])) >= EDGE_RUNS)
    return pd.DataFrame([(pdf["_eh"].iloc[0], pdf["_en"].iloc[0], *held)], columns=["_eh", "_en", "_first", "_last"])


def _groups(edges: DataFrame) -> DataFrame:
    """(_eh, _en, _group, _stands): ranges joined where the border before them does not stand."""
    row = W.partitionBy("_eh").orderBy("_en")
    order = F.row_number().over(W.partitionBy("_key.host", "_no", "_head").orderBy("_key"))
    found = edges.select(F.col("_key.host").alias("_eh"), F.col("_no").alias("_en"), "_head", order.alias("_order"), "html")
    found = found.groupBy("_eh", "_en").applyInPandas(_enough, "_eh string, _en int, _first boolean, _last boolean")
    found = found.withColumn("_stands", F.coalesce(F.col("_first") & F.lag("_last").over(row), F.lit(False)))
    return written(found.select("_eh", "_en", "_stands", F.sum(F.col("_stands").cast("int")).over(row).alias("_group")))


def _dealt(pages: DataFrame) -> DataFrame:
    """pages with _no, now the number of their group of ranges, and _guest: rows seen by the group next to theirs."""
    edges = written(_edges(pages))
    groups = _groups(edges)
    hint = F.broadcast if groups.count() <= BROADCAST_ROWS else lambda df: df
    met = lambda df, to: df.join(hint(to), (F.col("_key.host") == F.col("_eh")) & (F.col("_no") == F.col("_en")), "left")
    mine = met(pages, groups.select("_eh", "_en", "_group"))
    heads = met(edges.where("_head"), groups.where("_stands").select("_eh", "_en", (F.col("_group") - 1).alias("_group")))
    tails = met(edges.where("not _head"), groups.where("_stands").select("_eh", (F.col("_en") - 1).alias("_en"), "_group"))
    guests = heads.unionByName(tails).where("_group is not null").drop("_head")
    every = mine.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))
    return every.withColumn("_no", F.coalesce("_group", F.lit(0))).drop("_eh", "_en", "_group")


def extract(pages: DataFrame, range_pages: int = RANGE_PAGES) -> DataFrame:
    """(page_id, url, text) for every row of pages (page_id, url, html)."""
    url = F.col("url")
    # the html's hash at the end keeps rows that differ in it alone in one order
    key = F.struct(host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(url, F.lit("")).alias("url"), F.col("page_id").cast("string").alias("page"), F.xxhash64("html").alias("hash"))
    every = _dealt(_ranges(pages.select("page_id", "url", "html", key.alias("_key")), range_pages))
    every = every.select(F.concat_ws("#", "_key.host", "_no").alias("_range"), F.col("_key.host").alias("_host"), "_key", "_guest", F.col("page_id").cast("string").alias("page_id"), "url", "html")
    dealt = every.repartition("_range").sortWithinPartitions("_range", "_key", "_guest").drop("_key")
    done = dealt.mapInPandas(_kernel, "page_id string, url string, text string")
    return done.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
