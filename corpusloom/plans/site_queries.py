"""Queries over sites and bodies that are made from the tables so that each branch of an operator is met.

The SQL says what a crawl, an extractor or a rule has to give, from the way the input was made; it
shares nothing with the operators but the fixed values.
"""

from __future__ import annotations

import codecs

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import urls as U
from ..operators import dedup, politeness
from ..operators import extract as X
from ..sources import tables
from . import corpus
from .crawl import crawl, table_fetcher
from .queries import _CLEAN, _UNESCAPE, _WORDS, _extracted, query, table

# crawls: page i of a site links to pages 3i+1, 3i+2 and 3i+3, to the page before it and to the first one

_PROSE = "The people of the town were glad that it had rained and so they went out to see what was left of the old mill by the river. It was there. They were all in it, and that was it. Number {0} was not like the others."
_URL = "http://site.example.com/{0}/{1}.html"


def _site(spark, sf_dir, limit: int) -> tuple[DataFrame, DataFrame]:
    """Responses of a site with a page for each of the rows of ``pages``, and its redirects.

    By page number: 11k+2 fails once, 13k+7 always, 17k+5 is missing, 19k+6 lies under a forbidden
    path, 23k+9 moves.
    """
    n = min(limit, table(spark, sf_dir, "pages").count())
    i = F.col("id")
    kind = F.when(i % 19 == 6, "x").when(i % 23 == 9, "r").otherwise("p")
    url = lambda k, x: F.concat(F.lit("http://site.example.com/"), k, F.lit("/"), x.cast("string"), F.lit(".html"))
    at = lambda x: url(F.when(x % 19 == 6, "x").when(x % 23 == 9, "r").otherwise("p"), x)
    to = F.concat_ws("", *[F.concat(F.lit('<a href="'), at(x), F.lit('">next</a> ')) for x in (3 * i + 1, 3 * i + 2, 3 * i + 3, F.greatest(i - 1, F.lit(0)), F.lit(0) * i)])
    body = F.concat(F.lit('<html lang="en"><head><title>Page '), i.cast("string"), F.lit("</title></head><body><article>"), *[F.concat(F.lit("<p>"), F.replace(F.lit(_PROSE), F.lit("{0}"), i.cast("string")), F.lit("</p>")) for _ in range(4)], F.lit("</article><nav>"), to, F.lit("</nav></body></html>"))
    pages = spark.range(n).select(
        i.alias("i"), url(F.when(kind == "r", "p").otherwise(kind), i).alias("url"), F.when(i % 17 == 5, 404).otherwise(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.encode(body, "UTF-8").alias("body"),
        F.when(i % 11 == 2, "eof").when(i % 13 == 7, "net_timeout").alias("error"), F.when(i % 11 == 2, 1).alias("fail_attempts"),
    )
    moved = spark.range(n).where((i % 23 == 9) & (i % 19 != 6)).select(at(i).alias("src"), url(F.lit("p"), i).alias("dst"))
    return pages.drop("i"), moved


def _config(**crawler) -> Config:
    c = Config()
    c.content.quality_threshold, c.content.languages, c.crawler.max_depth, c.crawler.max_pages = 0.1, [], 0, 10**9
    c.content.deduplication.enabled = False
    for k, v in crawler.items():
        setattr(c.crawler, k, v)
    return c


def _crawled(spark, sf_dir, limit: int = 3000, **crawler):
    pages, moved = _site(spark, sf_dir, limit)
    raw = spark.createDataFrame([("site.example.com", 200, "User-agent: *\nDisallow: /x/\n")], "host string, status int, body string").withColumn("fetched_at", F.current_timestamp())
    return crawl(spark, _config(**crawler), ["http://site.example.com/p/0.html"], table_fetcher(pages, moved), robots=politeness.robots_table(raw))


_WALK = """WITH RECURSIVE n AS (SELECT least({limit}, count(*)) AS n FROM pages),
p AS (SELECT i, CASE WHEN i % 19 = 6 THEN 'x' WHEN i % 23 = 9 THEN 'r' ELSE 'p' END AS kind,
             CASE WHEN i % 19 = 6 THEN 'disallowed' WHEN i % 11 = 2 AND i % 17 <> 5 THEN 'once' WHEN i % 11 = 2 THEN 'once_missing' WHEN i % 13 = 7 THEN 'dead' WHEN i % 17 = 5 THEN 'missing' ELSE 'fine' END AS fate
      FROM (SELECT unnest(range((SELECT 3 * n + 4 FROM n)::BIGINT)) AS i)),
f AS (SELECT i, kind, CASE WHEN fate <> 'disallowed' AND i >= (SELECT n FROM n) THEN 'missing' ELSE fate END AS fate FROM p),
w(i, depth) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT 3 * w.i + k, w.depth + 1 FROM w JOIN f USING (i), (VALUES (1), (2), (3)) t(k) WHERE f.fate IN ('fine', 'once') AND w.depth < {depth}),
c AS (SELECT i, depth, kind, fate, 'http://site.example.com/' || kind || '/' || i || '.html' AS url FROM w JOIN f USING (i))
"""


@query(
    _WALK.format(limit=3000, depth=3)
    + """SELECT url, depth, CASE fate WHEN 'once' THEN 1 WHEN 'once_missing' THEN 1 WHEN 'dead' THEN 2 ELSE 0 END AS attempt, fate IN ('fine', 'once') AS success,
  CASE fate WHEN 'dead' THEN 'net_timeout' WHEN 'missing' THEN 'http_404' WHEN 'once_missing' THEN 'http_404' END AS error, CASE fate WHEN 'dead' THEN NULL WHEN 'missing' THEN 404 WHEN 'once_missing' THEN 404 ELSE 200 END AS status_code,
  CASE WHEN kind = 'r' AND i < (SELECT n FROM n) THEN replace(url, '/r/', '/p/') ELSE url END AS final_url, CASE WHEN kind = 'r' AND i < (SELECT n FROM n) THEN 1 ELSE 0 END AS hops,
  CASE WHEN fate NOT IN ('fine', 'once') THEN 0 WHEN i = 0 THEN 4 ELSE 5 - CASE WHEN i = 1 THEN 1 ELSE 0 END END AS n_links
FROM c WHERE fate <> 'disallowed'"""
)
def crawl_site(spark, sf_dir):
    """Links, retries, redirects, missing pages and robots rules of a breadth-first crawl, three links deep."""
    done = _crawled(spark, sf_dir, max_depth=3).results.where("not retried")
    return done.select("url", "depth", "attempt", "success", "error", "status_code", "final_url", F.size("redirect_chain").alias("hops"), F.size("links").alias("n_links"))


@query(
    _WALK.format(limit=3000, depth=2)
    + """SELECT count(*) AS dispatched, sum(CASE fate WHEN 'once' THEN 2 WHEN 'once_missing' THEN 2 WHEN 'dead' THEN 3 WHEN 'disallowed' THEN 0 ELSE 1 END)::BIGINT AS received, count(*) FILTER (fate IN ('fine', 'once')) AS succeeded,
  count(*) FILTER (fate IN ('dead', 'missing', 'once_missing')) AS failed, sum(CASE fate WHEN 'once' THEN 1 WHEN 'once_missing' THEN 1 WHEN 'dead' THEN 2 ELSE 0 END)::BIGINT AS retried, count(*) FILTER (fate = 'disallowed') AS disallowed FROM c"""
)
def crawl_counters(spark, sf_dir):
    """Counters of a crawl that meets each kind of failure."""
    s = _crawled(spark, sf_dir, max_depth=2).stats
    names = ("dispatched", "received", "succeeded", "failed", "retried", "disallowed")
    return spark.createDataFrame([tuple(int(s[n]) for n in names)], ", ".join(f"{n} long" for n in names))


_CAP = 40


def _tree(spark, n: int) -> DataFrame:
    """Pages without failures, whose breadth-first order is that of their numbers."""
    i = F.col("id")
    links = F.concat_ws("", *[F.concat(F.lit('<a href="/t/'), (3 * i + k).cast("string"), F.lit('">x</a>')) for k in (1, 2, 3)])
    body = F.concat(F.lit("<html><body><p>"), F.replace(F.lit(_PROSE), F.lit("{0}"), i.cast("string")), F.lit("</p>"), links, F.lit("</body></html>"))
    return spark.range(n).select(F.concat(F.lit("http://tree.example.com/t/"), i.cast("string")).alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.encode(body, "UTF-8").alias("body"))


@query(f"SELECT i AS page, CASE WHEN i < {_CAP} THEN 'crawled' ELSE 'pending' END AS state, floor(ln(2 * i + 1) / ln(3) + 1e-9)::INT AS depth FROM range({3 * _CAP + 1}) t(i)")
def crawl_page_cap(spark, sf_dir):
    """A crawl stops at its page cap in breadth-first order; what it has found stays pending."""
    out = crawl(spark, _config(max_pages=_CAP), ["http://tree.example.com/t/0"], table_fetcher(_tree(spark, 400)))
    page = F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page")
    return out.results.select(page, F.lit("crawled").alias("state"), "depth").unionByName(out.pending.select(page, F.lit("pending").alias("state"), "depth"))


@query("SELECT i AS page FROM range(0, 13) t(i) WHERE i IN (0, 1, 2, 4, 5)")
def crawl_queue_capacity(spark, sf_dir):
    """Found URLs beyond the capacity of the queue are dropped and not found again."""
    cfg = _config(max_depth=2)
    cfg.frontier.queue_capacity = 2
    out = crawl(spark, cfg, ["http://tree.example.com/t/0"], table_fetcher(_tree(spark, 400)))
    return out.results.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page"))


@query("SELECT o_orderkey AS page, o_custkey % 9 AS depth, (o_orderkey % 3)::INT AS attempt, false AS retry, CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END AS priority FROM orders")
def checkpoint_resume(spark, sf_dir):
    """Pending items written as a snapshot and read again: fresh numbers, no retry mark."""
    items = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("http://h.example.com/"), F.col("o_orderkey").cast("string")).alias("url"), (F.col("o_custkey") % 9).cast("int").alias("depth"), (F.col("o_orderkey") % 3).cast("int").alias("attempt"), F.when(F.col("o_orderstatus") == "F", 100).otherwise(0).alias("priority")
    )
    folder = f"{dedup.scratch_folder(spark)}/{dedup.hidden('state')}"
    tables.save_snapshot(items, folder)
    got = tables.load_snapshot(spark, folder)
    return got.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page"), F.col("depth").cast("long").alias("depth"), "attempt", "retry", "priority")


_ARTICLE_TEXT = rf"""left(trim(regexp_replace({_UNESCAPE.format("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)^.*<article>(.*)</article>.*$', '\\1'), '<[^>]*>', '', 'g')")}, '\s+', ' ', 'g')), 100000)"""


def _results(spark, sf_dir) -> DataFrame:
    rows = _extracted(spark, sf_dir, readability=False, min_text_length=1, quality_threshold=0.0)
    failed = F.col("page_id") % 9 == 4
    return rows.withColumns({
        "status_code": F.lit(200), "error": F.when(failed, "http_500"), "links": F.transform("content.links", lambda x: x["url"]),
        "completed_at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")), "rendered": F.col("page_id") % 2 == 0,
    })


@query(
    f"""WITH t AS (SELECT *, {_ARTICLE_TEXT} AS c FROM pages WHERE page_id % 9 <> 4)
SELECT url, 200 AS status_code, nullif(trim({_UNESCAPE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}), '') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS language, {_WORDS} AS word_count, 0 AS link_count, c AS text,
       strftime(to_timestamp(1700000000 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS crawled_at, CASE WHEN page_id % 2 = 0 THEN true END AS rendered FROM t"""
)
def corpus_records(spark, sf_dir):
    """Output records of captured pages; results with an error give none, blank fields are null."""
    return corpus.records(_results(spark, sf_dir)).drop("quality_score")


@query(f"SELECT url, nullif(trim({_UNESCAPE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}), '') AS title, CASE WHEN page_id % 2 = 0 THEN true END AS rendered FROM pages WHERE page_id % 9 <> 4")
def records_jsonl(spark, sf_dir):
    """Records written as JSON lines in two runs, the second appending, and read again."""
    rows = corpus.records(_results(spark, sf_dir)).select("url", "title", "rendered")
    path = f"{dedup.scratch_folder(spark)}/{dedup.hidden('lines')}"
    tables.write_jsonl(rows.where("rendered"), path)
    tables.write_jsonl(rows.where("rendered is null"), path, append=True)
    return spark.read.schema("url string, title string, rendered boolean").json(path)


# bodies of other kinds

_BARE = r"regexp_replace(coalesce(text, ''), '[^ -~¡-ÿ\n]', '', 'g')"
_XML_TYPES = ("application/xml", "text/xml; charset=utf-8", "application/rss+xml")


def _bare(c: str = "text"):
    """Text in printable Latin-1 characters and line ends, so that each charset holds it.

    The class names what goes: one that names what stays ("[^ -~¡-ÿ\\n]") takes Java some ten times as long.
    """
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x09\\x0B-\\x1F\\x7F-\\xA0\\x{100}-\\x{10FFFF}]", "")


_ABOUT = 600


@query(
    rf"""WITH b AS (SELECT doc_id, left(regexp_replace({_BARE}, '\s+', ' ', 'g'), 5000) AS t FROM documents),
d AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'About feed ' || doc_id WHEN 1 THEN repeat('x', {_ABOUT}) ELSE '' END AS about FROM b),
f AS (SELECT *, trim(regexp_replace('Feed ' || doc_id || ' A. Writer 2024-01-0' || (doc_id % 9 + 1) || ' ' || about || ' ' || t || ' ', ' +', ' ', 'g')) AS c FROM d)
SELECT doc_id, 'Feed ' || doc_id AS title, 'A. Writer' AS author, '2024-01-0' || (doc_id % 9 + 1) AS published, c AS text,
       CASE WHEN doc_id % 3 = 0 THEN about WHEN doc_id % 3 = 1 THEN repeat('x', 500) || '...' WHEN length(c) > 200 THEN trim(left(c, 200)) || '...' ELSE c END AS description,
       'http://feed.example.com/' || doc_id AS link, 1 AS n_links, {_WORDS} AS words, 'xml' AS kind FROM f"""
)
def xml_extract(spark, sf_dir):
    """Feeds of three XML types: title, author, date, text, description and absolute links."""
    t = F.substring(F.regexp_replace(_bare(), "[\\t\\n\\f\\r ]+", " "), 1, 5000)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    n, i = F.col("doc_id"), F.col("doc_id").cast("string")
    about = F.when(n % 3 == 0, F.concat(F.lit("About feed "), i)).when(n % 3 == 1, F.lit("x" * _ABOUT)).otherwise("")
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss><channel><title>Feed '), i, F.lit("</title> <author>A. Writer</author> <date>2024-01-0"), (n % 9 + 1).cast("string"), F.lit("</date> <description>"), about,
        F.lit('</description> <item url="http://feed.example.com/'), i, F.lit('" src="http://feed.example.com/'), i, F.lit('">'), esc(t), F.lit(' </item><enclosure src="/relative/a.mp3"/></channel></rss>'),
    )
    kind = F.element_at(F.array(*[F.lit(x) for x in _XML_TYPES]), (n % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("http://feed.example.com/").alias("url"), kind.alias("content_type"), F.encode(body, "UTF-8").alias("body"))
    c, m = F.col("content"), F.col("content.metadata")
    return X.extract(rows, X.Options(quality_threshold=0.0)).select(
        "doc_id", c["title"].alias("title"), m["author"].alias("author"), m["published_date"].alias("published"), c["clean_text"].alias("text"), m["description"].alias("description"), c["links"][0]["url"].alias("link"),
        F.size(c["links"]).alias("n_links"), m["word_count"].alias("words"), m["custom_metadata"]["content_type"].alias("kind"),
    )


@query(
    rf"""WITH b AS (SELECT doc_id, left({_BARE}, 100000) AS raw FROM documents), l AS (SELECT doc_id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS n FROM b),
q AS (SELECT doc_id, n, trim(line, e' \t\n\f\r ') AS line FROM l), fits AS (SELECT doc_id, arg_min(line, n) AS line FROM q WHERE strlen(line) > 5 AND strlen(line) < 200 AND length(regexp_replace(line, '[A-Za-z0-9 :-]', '', 'g')) / strlen(line) < 0.1 GROUP BY doc_id),
c AS (SELECT doc_id, raw AS c FROM b)
SELECT doc_id, CASE WHEN c = '' THEN '' WHEN line IS NOT NULL THEN line WHEN length(c) > 50 THEN trim(left(c, 50), e' \t\n\f\r ') || '...' ELSE trim(c, e' \t\n\f\r ') END AS title, c AS text,
       len(list_filter(string_split(c, chr(10) || chr(10)), lambda x: trim(x, e' \t\n\f\r ') <> '')) AS paragraphs, len(regexp_extract_all(c, '[^\s ]+')) AS words, CASE WHEN c = '' THEN 'empty_content' END AS reject_reason
FROM c LEFT JOIN fits USING (doc_id)"""
)
def plain_extract(spark, sf_dir):
    """Plain text with its lines: the title is the first fitting one, and blank lines part paragraphs."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("http://t.example.com/").alias("url"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.encode(_bare(), "UTF-8").alias("body"))
    c = F.col("content")
    got = X.extract(rows, X.Options(normalize_whitespace=False, quality_threshold=0.0))
    blank = lambda x: F.coalesce(x, F.lit(""))
    count = lambda x: F.coalesce(x, F.lit(0))
    return got.select("doc_id", blank(c["title"]).alias("title"), blank(c["clean_text"]).alias("text"), count(c["metadata"]["paragraph_count"]).alias("paragraphs"), count(c["metadata"]["word_count"]).alias("words"), "reject_reason")


#: Encoding of a body, the content type that goes with it, and the meta element it begins with.
_ENCODED = (
    ("UTF-8", "text/html", ""), ("ISO-8859-1", "text/html; charset=latin1", ""), ("ISO-8859-1", "text/html", '<meta charset="x-cp1252">'), ("UTF-16LE", "text/html; charset=nonsense", codecs.BOM_UTF16_LE),
    ("UTF-16BE", "text/html", codecs.BOM_UTF16_BE), ("UTF-16LE", "text/html; charset=unicode", ""), ("ISO-8859-1", "text/html; charset=\"us-ascii\"", ""),
)


@query(rf"SELECT doc_id, trim(regexp_replace('Title ' || regexp_replace({_BARE}, '[<>&\n]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM documents")
def charset_decode(spark, sf_dir):
    """Bodies by declared label, meta element, byte order mark or none of them, all with the same text."""
    text = F.regexp_replace(_bare(), "[<>&\\n]", " ")
    n = F.col("doc_id") % len(_ENCODED)
    body, kind = F.lit(None).cast("binary"), F.lit(None).cast("string")
    for k, (name, declared, start) in enumerate(_ENCODED):
        page = F.concat(F.lit("<html><head>" + (start if isinstance(start, str) else "") + "<title>Title "), text, F.lit("</title></head></html>"))
        made = F.encode(page, name)
        body = F.when(n == k, made if isinstance(start, str) else F.concat(F.lit(start), made)).otherwise(body)
        kind = F.when(n == k, declared).otherwise(kind)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("http://t.example.com/").alias("url"), kind.alias("content_type"), body.alias("body"))
    got = X.extract(rows, X.Options(links=False, images=False, metadata=False, readability=False, quality_threshold=0.0))
    return got.select("doc_id", F.trim(F.regexp_replace("content.title", "\\s+", " ")).alias("title"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Author ' || doc_id WHEN 1 THEN 'Writer ' || doc_id WHEN 2 THEN 'Byline ' || doc_id ELSE '' END AS author,
  CASE doc_id % 4 WHEN 0 THEN '2024-02-0' || (doc_id % 9 + 1) WHEN 1 THEN '2023-02-0' || (doc_id % 9 + 1) WHEN 2 THEN 'May ' || (doc_id % 9 + 1) ELSE '' END AS published, CASE WHEN doc_id % 2 = 0 THEN '2024-03-01' ELSE '' END AS modified,
  CASE doc_id % 3 WHEN 0 THEN 'Described ' || doc_id WHEN 1 THEN 'Open ' || doc_id ELSE '' END AS description, 'alpha,beta ' || doc_id || ',gamma' AS keywords, 'blue,green ' || doc_id || ',News' AS tags, 'News' AS categories,
  'og:' || CASE doc_id % 3 WHEN 1 THEN 'Open ' || doc_id ELSE '' END || ' tw:card' || doc_id || ' ld:{"n": ' || doc_id || '}' AS custom, CASE doc_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'pt' END AS language, 2 AS paragraphs, 1 AS links, 1 AS images FROM documents"""
)
def metadata_fields(spark, sf_dir):
    """Each field of page metadata by each of the places that it is read from."""
    n, i = F.col("doc_id"), F.col("doc_id").cast("string")
    day = (n % 9 + 1).cast("string")
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    head = cat(
        F.when(n % 3 == 0, '<html lang="de-AT">').otherwise("<html>"), "<head>",
        F.when(n % 4 == 0, cat('<meta name="author" content="Author ', i, '"><meta property="article:published_time" content="2024-02-0', day, '">')).when(n % 4 == 1, cat('<meta name="twitter:creator" content="Writer ', i, '">')).otherwise(""),
        F.when(n % 2 == 0, '<meta name="last-modified" content="2024-03-01">').otherwise(""), F.when(n % 3 == 0, cat('<meta name="description" content="Described ', i, '">')).when(n % 3 == 1, cat('<meta property="og:description" content="Open ', i, '"><meta name="language" content="FR-ca">')).otherwise('<meta property="og:locale" content="pt_BR">'),
        '<meta name="keywords" content="alpha, beta ', i, ', ,alpha"><meta property="article:tag" content="gamma"><meta name="twitter:card" content="card', i, '"><script type="application/ld+json">{"n": ', i, "}</script></head>",
    )
    body = cat(
        "<body>", F.when(n % 4 == 1, cat('<time datetime="2023-02-0', day, '">then</time>')).when(n % 4 == 2, cat('<p class="byline">Byline ', i, '</p><span class="published">May ', day, "</span>")).otherwise("<p>one</p>"), F.when(n % 4 == 1, "<p>one</p>").otherwise(""),
        "<p>" + _PROSE + "</p>" + '<span class="tag">blue</span><a rel="tag" href="/g">green ', i, '</a><b class="category">News</b><img src="/i.png"></body></html>',
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("http://t.example.com/").alias("url"), F.lit("text/html").alias("content_type"), F.encode(F.concat(head, body), "UTF-8").alias("body"))
    m = F.col("content.metadata")
    x = m["custom_metadata"]
    return X.extract(rows, X.Options(links=False, images=False, quality_threshold=0.0)).select(
        "doc_id", m["author"].alias("author"), m["published_date"].alias("published"), m["modified_date"].alias("modified"), m["description"].alias("description"), F.array_join(m["keywords"], ",").alias("keywords"), F.array_join(m["tags"], ",").alias("tags"),
        F.array_join(m["categories"], ",").alias("categories"), F.concat(F.lit("og:"), F.coalesce(x["og_description"], F.lit("")), F.lit(" tw:"), x["twitter_card"], F.lit(" ld:"), x["json_ld_0"]).alias("custom"), m["language"].alias("language"),
        m["paragraph_count"].alias("paragraphs"), m["link_count"].alias("links"), m["image_count"].alias("images"),
    )


@query(
    """WITH h AS (SELECT page_id, 'http://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM pages)
SELECT page_id, host || u AS image, alt, width, caption, k IN ('figure') AS in_figure FROM h, (VALUES ('figure', '/a.png', 'A', '300px', 'Seen here'), ('lazy', '/b.png', '', '', ''), ('div', '/c.png', 'C', '50', 'In a box'), ('after', '/d.png', 'D', '', 'Behind it'), ('style', '/bg.jpg', '', '', '')) v(k, u, alt, width, caption)"""
)
def image_places(spark, sf_dir):
    """Images of every page by source, lazy source and background, once each, with their captions."""
    body = (
        '<body><figure><img src="/a.png" alt="A" width="300px"><figcaption> Seen here </figcaption></figure><p><img data-src="b.png"><img src="/a.png" alt="again"></p>'
        '<div><img src="/c.png" alt="C" width="50"><span class="caption">In a box</span></div><section><img src="/d.png" alt="D"><p class="img-caption">Behind it</p></section><b style="background-image: url(\'/bg.jpg\')"></b></body>'
    )
    pages = table(spark, sf_dir, "pages")
    site = F.concat(F.lit("http://"), F.lower(U.host(F.col("url"))), F.lit("/x/y.html"))
    rows = pages.select("page_id", site.alias("url"), F.lit("text/html").alias("content_type"), F.encode(F.lit(body), "UTF-8").alias("body"))
    got = X.extract(rows, X.Options(links=False, metadata=False, quality_threshold=0.0)).select("page_id", F.explode("content.images").alias("i"))
    return got.select("page_id", F.col("i.url").alias("image"), F.col("i.alt").alias("alt"), F.col("i.width").alias("width"), F.col("i.caption").alias("caption"), F.col("i.url").endswith("/a.png").alias("in_figure"))


@query(
    """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages WHERE page_id % 2 = 0)
SELECT DISTINCT page_id, scheme || '://' || host || href AS link FROM p"""
)
def rejected_page_links(spark, sf_dir):
    """Links of pages by selectors: pages that the gate rejects, here those with an even number, give those of their menus too."""
    pages = table(spark, sf_dir, "pages")
    captured = pages.select("page_id", "url", F.lit("text/html; charset=utf-8").alias("content_type"), F.encode("html", "UTF-8").alias("body"))
    on = dict(images=False, metadata=False, readability=False)
    low = X.extract(captured.where("page_id % 2 = 0"), X.Options(quality_threshold=2.0, **on)).where("reject_reason is not null")
    fine = X.extract(captured.where("page_id % 2 = 1"), X.Options(quality_threshold=0.0, **on)).where("reject_reason is null")
    return low.unionByName(fine).select("page_id", F.explode("content.links").alias("l")).select("page_id", F.col("l.url").alias("link"))


_TYPES = ("text/html; charset=utf-8", "TEXT/PLAIN", "application/xhtml+xml", "application/xml", "text/xml", "application/rss+xml", "application/atom+xml", "application/json", "image/png", "application/pdf", "", "video/mp4", "application/octet-stream")
_TYPE_SQL = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TYPES))


@query(
    f"""SELECT event_id, t AS content_type, CASE WHEN i IN (0, 2, 7, 8, 9, 10, 11, 12) THEN 'html' WHEN i = 1 THEN 'plain' ELSE 'xml' END AS kind, i < 7 AS supported, i IN (0, 1, 2, 3, 10) AS allowed
FROM events JOIN (VALUES {_TYPE_SQL}) v(i, t) ON event_id % {len(_TYPES)} = i"""
)
def content_types(spark, sf_dir):
    """Dispatch, support and admission of content types."""
    t = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("event_id") % len(_TYPES) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", t.alias("content_type"))
    c = F.col("content_type")
    return rows.select("event_id", "content_type", X.kind(c).alias("kind"), X.type_supported(c).alias("supported"), U.type_allowed(c).alias("allowed"))


# URLs that meet every rule

_VARIANTS = (
    ("'HTTP://Example.COM:80/a/./b/../c' || n || '?b=2&a=' || n || '#top'", "'http://example.com/a/c' || n || '?a=' || n || '&b=2'"),
    ("'https://User@Example.com:443//x//' || n || '/'", "'https://User@example.com/x/' || n"),
    ("'http://10.0.' || (n % 256) || '.9:8080/p?utm_source=s&z=&k=' || n", "'http://10.0.' || (n % 256) || '.9:8080/p?k=' || n"),
    ("'http://h.example.com/q?s=a b&t=~' || n", "'http://h.example.com/q?s=a+b&t=~' || n"),
    ("'http://h.example.com/%zz' || n", "NULL"),
    ("'://h.example.com/' || n", "NULL"),
    ("'http://h.example.com:port/' || n", "NULL"),
    ("'http://h.example.com/../../up' || n", "'http://h.example.com/up' || n"),
    ("'http://h.example.com?ref=x&v=' || n", "'http://h.example.com?v=' || n"),
)


def _variant_sql(which: int) -> str:
    return "CASE page_id % {0} {1} END".format(len(_VARIANTS), " ".join(f"WHEN {k} THEN {v[which].replace('n ||', 'page_id ||').replace('|| n', '|| page_id').replace('(n %', '(page_id %')}" for k, v in enumerate(_VARIANTS)))


@query(f"SELECT page_id, {_variant_sql(1)} AS normalized, page_id % {len(_VARIANTS)} = 2 AS is_ip, CASE page_id % {len(_VARIANTS)} WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.com' WHEN 2 THEN '10.0.' || (page_id % 256) || '.9' WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'h.example.com' END AS domain, page_id % {len(_VARIANTS)} NOT IN (4, 5, 6) AS is_domain FROM pages")
def url_variants(spark, sf_dir):
    """Normal forms of URLs with ports, dot segments, users, escapes, trackers and faults."""
    made = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_variant_sql(0)} AS url")
    n = U.normalize(F.col("url"))
    d = F.lower(U.domain(F.col("url")))
    return made.select("page_id", n.alias("normalized"), F.coalesce(U.is_ip(d), F.lit(False)).alias("is_ip"), d.alias("domain"), U.is_domain(d).alias("is_domain"))


_REASONS = (
    ("http://ok.example.com/a/b.html", None), ("ftp://ok.example.com/a", "scheme"), ("http://localhost/a", "domain"), ("http://sub.bad.example.net/a", "domain"), ("http://ok.example.com/private/a", "pattern"), ("http://ok.example.com/other/a", "pattern"),
    ("http://ok.example.com/a/b.pdf", "extension"), ("http://ok.example.com/a/v1.2", "extension"), ("http://ok.example.com/a/" + "x" * 80, "length"), ("http://ok.example.com/a/b/c/d/e", "depth"), ("", "empty"), ("http:///a", "domain"), ("http://127.0.0.1/a", "domain"),
)
_ALL_RULES = U.Rules(block=(*U.LOCAL_HOSTS, "bad.example.net"), include=("/a",), exclude=("/private/", "["), max_bytes=100, max_depth=4)


@query("SELECT event_id, url, reason FROM events JOIN (VALUES " + ", ".join(f"({i}, '{u}', {'NULL' if r is None else repr(r)})" for i, (u, r) in enumerate(_REASONS)) + f") v(i, url, reason) ON event_id % {len(_REASONS)} = i")
def url_reject_reasons(spark, sf_dir):
    """The first rule that a URL breaks, for each rule: scheme, host, include and exclude patterns, extension, length, depth."""
    u = F.element_at(F.array(*[F.lit(x) for x, _ in _REASONS]), (F.col("event_id") % len(_REASONS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", u.alias("url"))
    return rows.select("event_id", "url", _ALL_RULES.reject_reason(F.when(F.col("url") == "http://ok.example.com/other/a", "http://ok.example.com/other/z").otherwise(F.col("url"))).alias("reason"))


# politeness

_BODIES = (
    (200, "User-agent: *\nDisallow: /de/\nAllow: /de/1\n", "none"), (200, "User-agent: loom\nAllow: /\n\nUser-agent: *\nDisallow: /\n", "named"), (200, "User-agent: *\nDisallow: /*/1\nCrawl-delay: 2.9\n", "wild"), (404, "User-agent: *\nDisallow: /\n", "gone"),
    (500, "", "fault"), (200, "User-agent: other\nDisallow: /\nUser-agent: loom\nUser-agent: third\nDisallow: /en/\nAllow: /en/\nCrawl-delay: 7\n", "tie"), (403, "", "barred"),
)


@query(
    rf"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, length(host) % {len(_BODIES)} AS k FROM p)
SELECT page_id, CASE k WHEN 0 THEN NOT (path LIKE '/de/%' AND NOT path LIKE '/de/1%') WHEN 2 THEN NOT regexp_matches(path || CASE WHEN q = '' THEN '' ELSE '?' || q END, '^/.*/1') ELSE true END AS allowed,
       CASE k WHEN 2 THEN 2 WHEN 5 THEN 7 ELSE 0 END::BIGINT AS delay_s, CASE WHEN k = 4 THEN 'status' END AS error FROM k"""
)
def robots_groups(spark, sf_dir):
    """Rules of several groups: named agents, wild cards, longest match, equals, delays, and answers other than 200."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    k = F.length("host") % len(_BODIES)
    pick = lambda n: F.element_at(F.array(*[F.lit(b[n]) for b in _BODIES]), k + 1)
    hosts = pages.select(F.lower(U.host(F.col("url"))).alias("host")).distinct()
    raw = hosts.select("host", pick(0).alias("status"), pick(1).alias("body"), F.current_timestamp().alias("fetched_at"))
    got = politeness.check_robots(pages, politeness.robots_table(raw), "loom/1.0")
    return got.select("page_id", F.col("robots.allowed").alias("allowed"), F.col("robots.crawl_delay_s").alias("delay_s"), F.col("robots_error").alias("error"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN least(3.0::DOUBLE, 1.0::DOUBLE / (c_custkey % 4)) ELSE 3.0::DOUBLE END AS rate, c_custkey % 4 > 0 AS tight FROM customer")
def crawl_delay_rates(spark, sf_dir):
    """A delay of the rules only tightens the rate of a host."""
    rate, tight = politeness.crawl_delay_rate(F.lit(3.0), F.col("c_custkey") % 4)
    return table(spark, sf_dir, "customer").select("c_custkey", rate.alias("rate"), tight.alias("tight"))


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY (c_custkey * 7919) % 10007 DESC, lpad(c_custkey::VARCHAR, 12, '0')) AS r, count(*) OVER () AS n FROM customer) WHERE n < 100 OR r <= 90")
def limiter_eviction(spark, sf_dir):
    """Beyond the cap the nine tenths of it that were used last stay."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("host"), ((F.col("c_custkey") * 7919) % 10007).alias("last_used"))
    return politeness.evict(rows, 100).select("c_custkey")


@query("SELECT count(*) AS entries, count(*) FILTER (o_orderkey % 50 >= 24) AS expired, min(o_orderkey % 50) * 3600 AS min_age_s, max(o_orderkey % 50) * 3600 AS max_age_s, round(avg((o_orderkey % 50) * 3600), 4)::DOUBLE AS avg_age_s, 0.0::DOUBLE AS hit_rate FROM orders")
def robots_cache(spark, sf_dir):
    """Age and expiry of cached rules, a day after they were had."""
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    raw = table(spark, sf_dir, "orders").select(F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("host"), F.lit(200).alias("status"), F.lit("").alias("body"), F.timestamp_seconds(F.unix_timestamp(now) - (F.col("o_orderkey") % 50) * 3600).alias("fetched_at"))
    return politeness.cache_stats(politeness.robots_table(raw), now).withColumn("avg_age_s", F.round("avg_age_s", 4))


_ERRORS = (*politeness.RETRY_ERRORS, "tls", "bad_url", "dns_permanent", "too_many_redirects")


@query(f"SELECT event_id, event_id % {len(_ERRORS)} < {len(politeness.RETRY_ERRORS)} AS by_error, (event_id % 120 + 400) IN (429, 500, 502, 503, 504) AS by_status, CASE WHEN event_id % 6 = 0 THEN 0 ELSE least(500 * pow(2, event_id % 6 - 1), 30000)::BIGINT END AS wait_ms FROM events")
def retry_errors(spark, sf_dir):
    """Every class of error and status, with the wait before the next attempt."""
    e = F.element_at(F.array(*[F.lit(x) for x in _ERRORS]), (F.col("event_id") % len(_ERRORS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", politeness.retryable_error(e).alias("by_error"), politeness.retryable_status(F.col("event_id") % 120 + 400).alias("by_status"), politeness.exponential_delay_ms(F.col("event_id") % 6).alias("wait_ms"))


@query("SELECT sha256(coalesce(text, '')) AS hash, 'http://d.example.com/' || max(doc_id) AS url FROM documents GROUP BY 1")
def dedup_store(spark, sf_dir):
    """Content hashes in a store: the last writer's URL is the one that is found."""
    path = f"{dedup.scratch_folder(spark)}/{dedup.hidden('store')}"
    h = dedup.content_hash(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select(F.lit("content").alias("hash_type"), h.alias("hash"), F.concat(F.lit("http://d.example.com/"), F.col("doc_id").cast("string")).alias("url"), F.timestamp_seconds("doc_id").alias("inserted_at"))
    rows.write.partitionBy("hash_type").parquet(path)
    return dedup.original_url(spark.read.parquet(path), "content").select("hash", "url")
