import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom import api
from corpusloom.config import Config
from corpusloom.plans import corpus
from corpusloom.plans.crawl import bfs_depths, crawl, table_fetcher
from corpusloom.operators import politeness
from corpusloom.sources import tables

WORDS = "the people of the town were glad that it had rained and so they went out to see what was left of the old mill".split()
KIND = "url string, status int, content_type string, body binary, error string, fail_attempts int"


def body(name, links=(), lang="en"):
    """Prose of its own for each name, so that pages are no copies of each other."""
    own = " ".join(f"{w} {name}{i * 7919 % 1013}x{hash((name, i)) % 9973}" if i % 2 else w for i, w in enumerate(WORDS * 4))
    return f'<html lang="{lang}"><head><title>{name}</title></head><body><main><p>{own}. It was so.</p><p>They were there. It was theirs.</p>{"".join(f"<a href={chr(34)}{x}{chr(34)}>x</a>" for x in links)}</main></body></html>'


def site(spark, pages):
    rows = [(f"http://h.com{p}", 200, "text/html", body(p.strip("/") or "root", links, lang).encode(), err, n) for p, links, lang, err, n in pages]
    return spark.createDataFrame(rows, KIND)


def graph(spark, links):
    return site(spark, [(p, to, "en", None, None) for p, to in links.items()])


def config(**flags):
    c = Config()
    c.content.quality_threshold, c.crawler.max_depth, c.content.languages = 0.1, 0, []
    for k, v in flags.items():
        section, _, name = k.partition("__")
        setattr(getattr(c, section), name, v)
    return c


def paths(out):
    return sorted(r.url.removeprefix("http://h.com") for r in out.results.where("not retried").collect())


def test_cycles_depth_caps_and_seeds(spark):
    g = graph(spark, {"/a": ["/b", "/c"], "/b": ["/a", "/b"], "/c": ["/d"], "/d": []})
    out = crawl(spark, config(), ["http://h.com/a", " http://h.com/a ", "http://H.com/a#x"], table_fetcher(g))
    assert paths(out) == ["/a", "/b", "/c", "/d"] and (out.stats["received"], out.stats["succeeded"], out.stats["dispatched"]) == (4, 4, 4)
    chain = graph(spark, {f"/{i}": [f"/{i + 1}"] for i in range(5)})
    assert paths(crawl(spark, config(crawler__max_depth=2), ["http://h.com/0"], table_fetcher(chain))) == ["/0", "/1", "/2"]
    star = graph(spark, {"/s": [f"/l{i}" for i in range(5)], **{f"/l{i}": [] for i in range(5)}})
    out = crawl(spark, config(crawler__max_pages=3), ["http://h.com/s"], table_fetcher(star))
    assert out.stats["dispatched"] == 3 and paths(out) == ["/l0", "/l1", "/s"] and out.pending.count() == 3
    out = crawl(spark, config(frontier__queue_capacity=2), ["http://h.com/s"], table_fetcher(star))
    assert paths(out) == ["/l0", "/l1", "/s"] and out.stats["dropped"] == 3


def test_retries(spark):
    dead = site(spark, [("/", (), "en", "eof", None)])
    out = crawl(spark, config(), ["http://h.com/"], table_fetcher(dead))
    assert [out.stats[k] for k in ("retried", "failed", "received")] == [2, 1, 3]
    once = site(spark, [("/", (), "en", "eof", 1)])
    out = crawl(spark, config(), ["http://h.com/"], table_fetcher(once))
    assert [out.stats[k] for k in ("retried", "succeeded")] == [1, 1]
    out = crawl(spark, config(), ["http://h.com/none"], table_fetcher(once))
    assert (out.stats["failed"], out.results.head().error) == (1, "http_404")


def test_robots_and_sitemaps(spark):
    g = graph(spark, {"/": [], "/a": [], "/b": []})
    raw = spark.createDataFrame([("h.com", 200, "User-agent: *\nDisallow: /\n")], "host string, status int, body string").withColumn("fetched_at", F.current_timestamp())
    deny = politeness.robots_table(raw)
    out = crawl(spark, config(), ["http://h.com/"], table_fetcher(g), robots=deny)
    assert (out.stats["received"], out.stats["disallowed"]) == (0, 1)
    assert crawl(spark, config(robots__enabled=False), ["http://h.com/"], table_fetcher(g), robots=deny).stats["received"] == 1
    asked = []

    def source(hosts):
        asked.append([r.host for r in hosts.collect()])
        return raw.withColumn("body", F.lit(""))

    docs = spark.createDataFrame([("http://h.com/sitemap.xml", b"<urlset><url><loc>http://h.com/a</loc></url><url><loc>http://h.com/b</loc></url></urlset>")], "doc string, body binary")
    out = crawl(spark, config(), ["http://h.com/"], table_fetcher(g), robots=source, sitemaps=lambda d: docs.join(d, "doc", "left_semi"))
    assert paths(out) == ["/", "/a", "/b"] and asked[0] == ["h.com"]


def test_redirects(spark):
    g = graph(spark, {"/end": []})
    hops = spark.createDataFrame([("http://h.com/s", "http://h.com/m"), ("http://h.com/m", "http://h.com/end"), ("http://h.com/loop", "http://h.com/loop")], "src string, dst string")
    out = crawl(spark, config(), ["http://h.com/s", "http://h.com/loop"], table_fetcher(g, hops))
    got = {r.url: r for r in out.results.collect()}
    assert got["http://h.com/s"].final_url == "http://h.com/end" and got["http://h.com/s"].redirect_chain == ["http://h.com/s", "http://h.com/m"]
    assert got["http://h.com/loop"].error == "too_many_redirects"


def test_output_filters_and_jsonl(spark, tmp_path):
    pages = site(spark, [("/", ["/fr", "/twin", "/copy"], "en", None, None), ("/fr", ["/deep"], "fr", None, None), ("/deep", (), "en", None, None)])
    twin = pages.where("url = 'http://h.com/'").select(F.explode(F.array(F.lit("http://h.com/twin"), F.lit("http://h.com/copy"))).alias("url"), "status", "content_type", "body", "error", "fail_attempts")
    cfg = config(content__languages=["en"])
    path = str(tmp_path / "out")
    stats = api.crawl_to_jsonl(spark, cfg, ["http://h.com/"], table_fetcher(pages.unionByName(twin)), path)
    assert (stats["received"], stats["duplicate"], stats["wrong_language"]) == (5, 2, 1)
    rows = [json.loads(line) for f in os.listdir(path) if f.endswith(".json") for line in open(f"{path}/{f}", encoding="utf-8")]
    assert sorted(r["url"] for r in rows) == ["http://h.com/", "http://h.com/deep"]
    assert set(rows[0]) <= set(corpus.FIELDS) and "rendered" not in rows[0] and rows[0]["crawled_at"].endswith("Z")


def test_seen_set_and_resume(spark, tmp_path):
    g = graph(spark, {"/s": [f"/l{i}" for i in range(5)], **{f"/l{i}": [] for i in range(5)}})
    first = crawl(spark, config(crawler__max_pages=3), ["http://h.com/s"], table_fetcher(g))
    folder = str(tmp_path / "state")
    tables.save_snapshot(first.pending, folder)
    done = first.results.select("url")
    second = crawl(spark, config(), ["http://h.com/s"], table_fetcher(g), seen=first.seen, resume=tables.load_snapshot(spark, folder))
    assert sorted(paths(first) + paths(second)) == sorted(["/s"] + [f"/l{i}" for i in range(5)])
    third = crawl(spark, config(), ["http://h.com/s"], table_fetcher(g), seen=done)
    assert third.stats["received"] == 0
    tables.write_items(first.pending, str(tmp_path / "items"))
    assert spark.read.json(str(tmp_path / "items")).count() == 3
    with pytest.raises(ValueError):
        tables.seeds(spark, " , ")


def test_killed_crawl_goes_on_from_its_state(spark, tmp_path):
    g = graph(spark, {"/s": ["/a", "/b"], "/a": ["/c"], "/b": ["/s"], "/c": ["/d"], "/d": []})
    folder, ticks, rounds = str(tmp_path / "state"), [], []
    assert tables.load_state(spark, folder) is None

    def save(pending, seen, results):
        tables.save_state(folder, pending, seen, results)
        ticks.append(1)
        if len(ticks) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        crawl(spark, config(), ["http://h.com/s"], table_fetcher(g), on_state=save, state_every_s=0, on_stats=rounds.append)
    assert [r["dispatched"] for r in rounds] == [1, 3]
    pending, seen, results = tables.load_state(spark, folder)
    assert [r.url for r in pending.collect()] == ["http://h.com/c"] and results.count() == 3
    assert {r.url[12:] for r in seen.collect()} == {"/s", "/a", "/b", "/c"}
    out = crawl(spark, config(), ["http://h.com/s"], table_fetcher(g), seen=seen, resume=pending, earlier=results)
    assert out.stats["dispatched"] == 2 and out.stats["received"] == 5
    assert {r.url[12:]: r["round"] for r in out.results.collect()} == {"/s": 1, "/a": 2, "/b": 2, "/c": 3, "/d": 4}
    tables.save_state(folder, out.pending, out.seen, done=True)
    pending, seen, results = tables.load_state(spark, folder)
    assert pending.isEmpty() and results is None and seen.distinct().count() == 5


def test_depths(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 3)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "node long")
    assert dict(bfs_depths(edges, roots).collect()) == {0: 0, 1: 1, 3: 1, 2: 2}
    assert dict(bfs_depths(edges, roots, 1).collect()) == {0: 0, 1: 1, 3: 1}
