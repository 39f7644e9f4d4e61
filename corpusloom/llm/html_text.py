"""Main text of pages: structure first, then differencing against the page with the nearest URL.

A page that declares its article gives the text of that element without the parts that never belong
to it.  Other pages keep the lines outside such parts; each is paired with the page of its host whose
URL path is nearest, the lines of both are aligned by a longest common subsequence, and lines they
share are deleted.  Lines of a declared article are not deleted, as articles may quote each other.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged

#: A quote without its partner, as in a broken tag, is a character like others, so such a tag ends at the next ">".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z)|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
#: Elements whose text is no part of an article wherever they are.
SKIP = frozenset("script style noscript template nav header footer aside form button select option textarea iframe svg math canvas audio video object dialog menu head title noembed noframes map datalist fieldset legend label input".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Words of class, id and role that mark such parts.
MARKS = frozenset(
    """ad ads advert advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus
    footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices alert overlay pager pagination
    popup promo promoted promotion recommended related replies reply search share sharing sidebar skip social sponsor
    sponsored subscribe subscription tags toolbar topbar widget contentinfo complementary disclaimer feedback""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar alertdialog".split())
_PART = re.compile(r"[a-z]+(?=[^a-z]|$)")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: An opening tag ends these open elements, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _marked(attrs: dict[str, str], inline: bool = False) -> bool:
    """Whether attributes hide an element or name it as no part of the article.

    Words in parts of names count for blocks only: prose may well hold ``<span class="search-term">``.
    """
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if inline:
        return not MARKS.isdisjoint(names.lower().split())
    return not MARKS.isdisjoint(_PART.findall(_CAMEL.sub("-", names).lower()))


def blocks(page: str | None) -> list[tuple[str, int, bool]]:
    """``(text, depth of declared articles, kept)`` of each block, white space collapsed.

    The depth is 0 outside, 1 in <main> and 2 in an <article>; ``kept`` is false inside other parts.
    """
    page = page or ""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, skipped, declared
    words: list[str] = []
    skipped, declared, at = False, 0, 0

    def flush():
        text = " ".join("".join(words).split())
        if text:
            out.append((text, declared, not skipped))
        words.clear()

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            words.append(_html.unescape(page[at:]))
            break
        if m.start() > at:
            words.append(_html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                words.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in INLINE:
                        flush()
                    elif stack[k][1] != (stack[k - 1][1] if k else False):
                        flush()
                    del stack[k:]
                    skipped, declared = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                    break
                if stack[k][0] in ("article", "main", "body", "table") and tag in INLINE | {"p", "li"}:
                    break
            if tag in ("p", "br"):
                words.append(" ")
            continue
        if tag == "br" or tag == "hr":
            words.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
            if end:
                at = page.find(">", at) + 1 or n
            words.append(" ")
            continue
        attrs = _attributes(m[3]) if m[3].strip(" /") else {}
        if tag in VOID:
            if tag not in INLINE:
                words.append(" ")
            continue
        if tag in CLOSES:
            what, until = CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in what:
                    flush()
                    del stack[k:]
                    skipped, declared = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                elif stack[k][0] in until:
                    break
        main = 2 if tag == "article" or attrs.get("itemprop") == "articleBody" or attrs.get("role") == "article" else 1 if tag == "main" or attrs.get("role") == "main" else 0
        drop = tag in SKIP or (tag not in ("html", "body") and not main and bool(attrs) and _marked(attrs, tag in INLINE))
        if main == 2 and attrs and _marked({k: attrs[k] for k in ("class", "id") if k in attrs}):
            main, drop = 0, True  # a teaser or a comment in an article element of its own
        if tag not in INLINE or drop:
            flush()
        if not m[3].endswith("/") or tag not in ("svg", "path"):
            stack.append((tag, skipped or drop, max(declared, 0 if skipped or drop else main)))
            skipped, declared = stack[-1][1], stack[-1][2]
    flush()
    return out


def page_lines(page: str | None) -> tuple[bool, list[str], list[int]]:
    """Whether the page declares its article; the lines of it, or else all outside other parts; and
    marks of the lines outside a declared article, in page order."""
    got = [(t, d) for t, d, kept in blocks(page) if kept]
    most = max((d for _, d in got), default=0)
    return most > 0, [t for t, d in got if d == most], [mark(t) for t, d in got if not d]


def mark(line: str) -> int:
    return zlib.crc32(line.encode("utf-8", "surrogatepass")) << 16 | len(line) & 65535


#: Matching pairs of lines, for each line, up to which they are gone through one by one.
MATCHES = 32


def common(a: list, b: list) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Equal ends are taken off first.  Where few lines match, matches are gone through one by one
    (Hunt-Szymanski); where lines repeat, rows of the table are bits of whole numbers and ``a`` is
    halved (Hirschberg), so time and memory follow no square of the repeats.
    """
    lo, hi, other = 0, len(a), len(b)
    while lo < min(hi, other) and a[lo] == b[lo]:
        lo += 1
    while hi > lo and other > lo and a[hi - 1] == b[other - 1]:
        hi, other = hi - 1, other - 1
    ends = {*range(lo), *range(hi, len(a))}
    a, b = a[lo:hi], b[lo:other]
    if not a or not b:
        return ends
    count = Counter(b)
    sparse = sum(count[x] for x in a) <= MATCHES * (len(a) + len(b))
    return ends | {lo + i for i in (_sparse(a, b) if sparse else _halved(a, b))}


def _row(a: list, b: list) -> int:
    """Bit ``j`` is 0 where the subsequence with ``b[: j + 1]`` is longer than with ``b[:j]``."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    full, masks = (1 << len(b)) - 1, {}
    v = full
    for x in a:
        m = masks.get(x)
        if m is None and x in where:
            bits = bytearray(len(b) // 8 + 1)
            for j in where[x]:
                bits[j >> 3] |= 1 << (j & 7)
            m = int.from_bytes(bits, "little")
            if len(where[x]) > 8:  # others are cheap to make again, and may be many
                masks[x] = m
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return v


def _lengths(v: int, n: int) -> list[int]:
    """Lengths with each beginning of ``b`` from the bits of ``_row``."""
    bits, out = v.to_bytes(n // 8 + 1, "little"), [0]
    for j in range(n):
        out.append(out[-1] + (not bits[j >> 3] >> (j & 7) & 1))
    return out


def _halved(a: list, b: list) -> set[int]:
    out: set[int] = set()
    todo = [(0, a, b)]
    while todo:
        at, x, y = todo.pop()
        if not x or not y:
            continue
        if len(x) == 1:
            if x[0] in y:
                out.add(at)
            continue
        mid, n = len(x) // 2, len(y)
        front = _lengths(_row(x[:mid], y), n)
        back = _lengths(_row(x[:mid - 1 : -1], y[::-1]), n)
        j = max(range(n + 1), key=lambda k: front[k] + back[n - k])
        todo += [(at, x[:mid], y[:j]), (at + mid, x[mid:], y[j:])]
    return out


def _sparse(a: list, b: list) -> set[int]:
    where: dict = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(ends, j)
            node = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(node)
            elif j < ends[k]:
                ends[k] = j
                links[k] = node
    out, node = set(), links[-1] if links else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Run:
    """Pages with the same lines that follow one another in a host; of its rows the ids and paths are held."""

    def __init__(self, host: str, path: str, marks: list):
        self.host, self.marks, self.first, self.last = host, marks, path, path
        self.rows: list[tuple] = []


def _shared(marks: list, path: str, near: list[tuple], known: dict) -> list[int]:
    """Lines of a page shared with the nearest of ``near`` by path; ``known`` keeps what its run has by position in ``near``."""
    i = max(range(len(near)), key=lambda j: _prefix(near[j][0], path))
    if i not in known:
        known[i] = sorted(common(marks, near[i][1]))
    return known[i]


PAIRED = "rid long, shared array<int>, part int, side int, host string, path string, marks array<long>"
#: Values of ``side``: rows of the first and of the last run of a range, and pages at its edges.
FIRST, LAST, HEAD, SECOND, TAIL, BEFORE = range(6)


def _pair(batches):
    """Shared lines of each undeclared page with the nearer of the differing pages before and after it.

    Rows come sorted by host and path.  Rows of the first and the last run of a range are left to
    ``_beyond``, with the two pages at each edge that differ.
    """
    part = TaskContext.get().partitionId()
    out: list[tuple] = []

    def pack():
        kinds = [f.split()[1] for f in PAIRED.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
        cols = [pa.array([r[i] for r in out], types[k]) for i, k in enumerate(kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in PAIRED.split(", ")])

    def left(run, side):
        for rid, path in run.rows:
            out.append((rid, None, part, side, None, path, None))
            if len(out) >= 1000:
                yield pack()

    def edge(side, host, path, marks):
        out.append((None, None, part, side, host, path, marks))

    def close(before, run, after):
        """``run`` has ended; ``before`` is the run ahead of it in the range."""
        if before is None:
            edge(HEAD, run.host, run.first, run.marks)
            if after:
                edge(SECOND, after.host, after.first, after.marks)
            yield from left(run, FIRST)
        elif after is None:
            yield from left(run, LAST)
        else:
            near = [(path, x.marks) for path, x in ((before.last, before), (after.first, after)) if x.host == run.host]
            known: dict = {}
            for rid, path in run.rows if near else ():
                out.append((rid, _shared(run.marks, path, near, known), None, None, None, None, None))
                if len(out) >= 1000:
                    yield pack()
        run.rows = []

    before = run = None
    for b in batches:
        for rid, host, path, needs, marks in zip(*[c.to_pylist() for c in b.columns[:5]]):
            if run is None:
                run = Run(host, path, marks)
            elif run.host != host or run.marks != marks:
                after = Run(host, path, marks)
                yield from close(before, run, after)
                before, run = run, after
            run.last = path
            if needs:
                run.rows.append((rid, path))
    if run:
        yield from close(before, run, None)
        edge(TAIL, run.host, run.last, run.marks)
        if before:
            edge(BEFORE, before.host, before.last, before.marks)
    if out:
        yield pack()


def _beyond(edges: list[tuple]) -> dict[tuple[int, int], tuple[list, list[tuple]]]:
    """By range and side the lines of its first or last run, and the path and lines of the differing pages about it.

    ``edges``: ``part, side, host, path, marks``.  A run may go on over any number of ranges.
    """
    at: dict[int, dict[int, tuple]] = {}
    for part, side, *page in edges:
        at.setdefault(part, {})[side] = page
    parts = sorted(at)

    def carry(order, mine, theirs, second):
        """The first differing page beyond each range, by the range that lies there."""
        found: dict[int, list | None] = {}
        for p, q in zip(order, [None, *order]):
            host, _, marks = at[p][mine]
            if q is None or at[q][theirs][0] != host:
                found[p] = None
            elif at[q][theirs][2] != marks:
                found[p] = at[q][theirs]
            else:  # the run goes on there, to its other edge if nothing follows
                found[p] = at[q].get(second) if second in at[q] else found[q]
            if found[p] and found[p][0] != host:
                found[p] = None
        return found

    ahead, behind = carry(parts, HEAD, TAIL, BEFORE), carry(parts[::-1], TAIL, HEAD, SECOND)
    out = {}
    for p in parts:
        e = at[p]
        for side, run, near in ((FIRST, e[HEAD], (ahead[p], e.get(SECOND, behind[p]))), (LAST, e[TAIL], (e.get(BEFORE, ahead[p]), behind[p]))):
            out[p, side] = run[2], [(x[1], x[2]) for x in near if x and x[0] == run[0]]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, from the whole html.

    Null and empty html gives an empty text.  Repeated rows come back as often as they came.  A null
    URL has the empty host.  Pages of a host lie in ranges by host and path, so a large host is
    spread; pages at the edges of a range are paired over the edge, so ranges don't change texts.
    Further columns are ignored; an empty table gives no rows.
    """
    kind = "rid long, page_id long, url string, text string, lines array<string>, marks array<long>"

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                text, lines, marks = [], [], []
                for page in part.column(3).to_pylist():
                    declared, got, outer = page_lines(page)
                    text.append(" ".join(got) if declared or not got else None)
                    lines.append(None if declared or not got else got)
                    marks.append(outer)
                cols = [pa.array(text, pa.string()), pa.array(lines, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *cols], ["rid", "page_id", "url", "text", "lines", "marks"])

    src = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parsed = staged(src.mapInArrow(run, kind), "lines")
    whole = parsed.where("text is not null").select("page_id", "url", "text")
    open_ = parsed.where("text is null")
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    keyed = parsed.select("rid", host.alias("host"), path.alias("path"), F.col("text").isNull().alias("needs"), "marks", F.xxhash64("marks").alias("same"))
    need = open_.select(host.alias("host")).distinct()  # hosts whose pages all declare their article need no pairs
    keyed = keyed.join(need, "host", "left_semi").select("rid", "host", "path", "needs", "marks", "same")
    order = ["host", "path", "same", "rid"]  # copies of a page follow one another
    paired = staged(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pair, PAIRED), "pairs")
    edges = paired.where(F.col("side") >= HEAD).select("part", "side", "host", "path", "marks").toArrow()  # four pages a range at most
    near = pages.sparkSession.sparkContext.broadcast(_beyond(list(zip(*[c.to_pylist() for c in edges.columns]))))

    def over(batches):
        known: dict = {}
        for b in batches:
            out = []
            for part, side, path in zip(*[c.to_pylist() for c in b.columns[1:4]]):
                marks, pages_near = near.value[part, side]
                out.append(_shared(marks, path, pages_near, known.setdefault((part, side), {})) if pages_near else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["rid", "shared"])

    at_edges = paired.where(F.col("side") <= LAST).select("rid", "part", "side", "path").mapInArrow(over, "rid long, shared array<int>")
    shared = paired.where("side is null").select("rid", "shared").unionByName(at_edges)
    left = F.filter("lines", lambda x, i: ~F.array_contains(F.coalesce("shared", F.array().cast("array<int>")), i))
    differed = open_.join(shared, "rid", "left").select("page_id", "url", F.array_join(left, " ").alias("text"))
    return whole.unionByName(differed).withColumn("n_chars", F.char_length("text").cast("long"))
