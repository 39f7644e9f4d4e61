import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import metrics, politeness
from corpusloom.sources import tables

ROBOTS = "User-agent: *\nDisallow: /private/\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 5.9\n\nUser-agent: special\nDisallow: /\nSitemap: http://e.com/s.xml\n"


@pytest.mark.parametrize(
    ("path", "agent", "allowed", "why"),
    [("/", "*", True, ""), ("/private/x", "*", False, "/private/"), ("/private/open/x", "*", True, ""), ("/a.pdf", "*", False, "/*.pdf$"), ("/a.pdf?x", "*", True, ""), ("/", "special-bot", False, "/"), ("/private/x", "other", False, "/private/")],
)
def test_robots_verdicts(path, agent, allowed, why):
    got = politeness.robots_verdict(ROBOTS, path, agent)
    assert (got[0], got[2], got[3]) == (allowed, why, ["http://e.com/s.xml"])
    assert got[1] == (0 if agent.startswith("special") else 5)


def test_robots_status_rules(spark):
    raw = [("a.com", 200, "User-agent: *\nDisallow: /"), ("b.com:80", 404, None), ("c.com", 503, None), ("d.com", None, None), ("e.com", 200, "x" * (500 * 1024)), ("f.com", 403, "Disallow")]
    table = politeness.robots_table(spark.createDataFrame(raw, "host string, status int, body string").withColumn("fetched_at", F.current_timestamp()))
    urls = spark.createDataFrame([(f"http://{h}.com/x",) for h in "abcdefg"], "url string")
    got = {r.url[7]: (r.robots.allowed, r.robots_error) for r in politeness.check_robots(urls, table).collect()}
    assert got == {"a": (False, None), "b": (True, None), "c": (True, "status"), "d": (True, "fetch"), "e": (True, "too_large"), "f": (True, None), "g": (True, None)}
    assert politeness.live(table, F.current_timestamp() + F.expr("interval 2 days")).count() == 0
    assert politeness.cache_stats(table, F.current_timestamp()).head().entries == 6


def test_token_bucket_equals_a_simulation(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for host in range(6):
        t, tokens, at = 0.0, 3.0, 0.0
        clock = 0.0
        for k in range(40):
            t += rng.choice([0.0, 0.1, 0.7, 3.0])
            go = max(t, clock)
            tokens = min(3.0, tokens + (go - at) * 2.0)
            if tokens < 1:
                go += (1 - tokens) / 2.0
                tokens = 1.0
            at, clock = go, go
            tokens -= 1
            rows.append((host, t, k))
            want[host, k] = go
    df = spark.createDataFrame(rows, "host int, arrival_s double, seq int")
    for r in politeness.dispatch(df, 2.0, 3).collect():
        assert r.dispatch_s == pytest.approx(want[r.host, r.seq], abs=1e-9)


def test_crawl_delay_only_tightens(spark):
    df = spark.createDataFrame([(3.0, 5.0), (3.0, 0.0), (0.1, 5.0), (3.0, 0.1)], "r double, d double")
    rate, tight = politeness.crawl_delay_rate(F.col("r"), F.col("d"))
    assert [tuple(x) for x in df.select(rate, tight).collect()] == [(0.2, True), (3.0, False), (0.1, True), (3.0, True)]


def test_backoff_and_retry_rules(spark):
    a = F.col("id")
    got = spark.range(-1, 9).select(politeness.exponential_delay_ms(a), politeness.linear_delay_ms(a)).collect()
    assert [r[0] for r in got] == [0, 0, 500, 1000, 2000, 4000, 8000, 16000, 30000, 30000] and [r[1] for r in got][:4] == [0, 0, 500, 1000]
    df = spark.createDataFrame([(429, "eof"), (500, "dns"), (404, None), (None, "canceled")], "s int, e string")
    assert [tuple(r) for r in df.select(politeness.retryable_status(F.col("s")), politeness.retryable_error(F.col("e"))).collect()] == [(True, True), (True, False), (False, False), (False, True)]


def test_eviction_and_metrics(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("host"), F.col("id").alias("last_used"))
    assert politeness.evict(df, cap=101).count() == 100
    assert sorted(r.last_used for r in politeness.evict(df, cap=50).collect()) == list(range(55, 100))
    rows = spark.createDataFrame([(1, True, 10.0), (1, False, 30.0), (2, True, 20.0)], "worker_id int, success boolean, response_time_ms double")
    m = metrics.engine_metrics(rows, 3.0).head()
    assert (m.total, m.succeeded, m.failed, m.jobs_per_s, m.avg_latency_ms) == (3, 2, 1, 1.0, 20.0) and m.error_rate == pytest.approx(100 / 3)
    assert {r.worker_id: (r.jobs, r.failed, r.avg_latency) for r in metrics.worker_stats(rows).collect()} == {1: (2, 1, 20.0), 2: (1, 0, 20.0)}
    assert metrics.engine_metrics(rows.limit(0), 3.0).head().error_rate == 0.0


def test_sitemaps_one_level_down(spark):
    docs = [
        ("http://h/sitemap.xml", "<sitemapindex><sitemap><loc> http://h/a.xml </loc></sitemap><sitemap><loc>http://h/missing.xml</loc></sitemap></sitemapindex>"),
        ("http://h/a.xml", "<urlset><url><loc>http://h/1</loc></url><url><loc>\n</loc></url><url><loc>http://h/2</loc></url></urlset>"), ("http://h/bad.xml", "<urlset><url>"),
    ]
    df = spark.createDataFrame([(d, b.encode()) for d, b in docs], "doc string, body binary")
    roots = spark.createDataFrame([("http://h", "http://h/sitemap.xml", 0), ("http://b", "http://h/bad.xml", 0)], "seed string, doc string, pos int")
    got = [(r.seed, r.loc, r.pos) for r in tables.discover(df, roots).orderBy("pos").collect()]
    assert got == [("http://h", "http://h/1", 1), ("http://h", "http://h/2", 2)]
    assert tables.discover(df, roots, max_docs=1).count() == 0 and tables.discover(df, roots, max_urls=1).count() == 1
