import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from corpusloom import cli
from corpusloom.config import Config
from corpusloom.plans.crawl import crawl
from corpusloom.sources import http

PROSE = "The people of the town were glad that it had rained, and so they went out to see what was left of the old mill. It was not much. But they had all been there. "


class Site(BaseHTTPRequestHandler):
    hits: dict = {}

    def do_GET(self):
        n = Site.hits[self.path] = Site.hits.get(self.path, 0) + 1
        if self.path == "/robots.txt":
            return self.send(200, "User-agent: *\nDisallow: /secret\n", "text/plain")
        if self.path == "/moved":
            return self.send(302, "", to="/b")
        if self.path == "/loop":
            return self.send(302, "", to="/loop")
        if self.path == "/shaky":
            return self.send(503 if n < 3 else 200, "ok")
        if self.path == "/down":
            return self.send(503, "")
        if self.path == "/sitemap.xml":
            return self.send(200, f"<urlset><url><loc>http://{self.headers['Host']}/c</loc></url></urlset>", "text/xml")
        links = {"/": ["/a", "/moved", "/secret/x"], "/a": ["/"]}.get(self.path, [])
        self.send(200, f"<html lang=en><title>{self.path}</title><body><p>{self.path * 3} {PROSE}</p><p>{PROSE}</p>{''.join(f'<a href={x}>l</a>' for x in links)}</body></html>", "text/html")

    do_HEAD = do_POST = do_GET

    def send(self, status, text, kind="text/plain", to=None):
        data = text.encode()
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(data)))
        if to:
            self.send_header("Location", to)
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture
def base():
    Site.hits = {}
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_client_retries_and_middleware(base):
    slept, log, counters = [], [], http.Counters()
    client = http.Client(http.Retry(base_ms=10), [http.with_log(log.append), http.with_counters(counters), http.with_timeout(5)], sleep=slept.append)
    assert client.get(base + "/shaky").body == b"ok" and slept == [0.01, 0.02] and counters.requests == 3 and log[-1].endswith("200")
    with pytest.raises(http.FetchError) as e:
        client.get(base + "/down")
    assert e.value.kind == "http_503" and Site.hits["/down"] == 4
    assert client.head(base + "/a").status == 200 and client.post(base + "/a", b"x").status == 200
    with pytest.raises(http.FetchError) as e:
        http.Client(http.Retry(most=0)).get("http://127.0.0.1:1/")
    assert e.value.kind == "connection_refused"
    linear = http.Retry(kind="linear", base_ms=100, cap_ms=250)
    assert [linear.delay_ms(i) for i in range(5)] == [0, 100, 200, 250, 250]


def test_session_follows_redirects_under_robots(base):
    s = http.Session(http.Client(http.Retry(most=0)), http.Limiters(1e9, 10))
    got, final, chain = s.fetch(base + "/moved")
    assert got.status == 200 and final == base + "/b" and chain == [base + "/moved"]
    for path, kind in (("/loop", "too_many_redirects"), ("/secret", "robots_disallowed")):
        with pytest.raises(http.FetchError) as e:
            s.fetch(base + path)
        assert e.value.kind == kind


def test_buckets():
    now, slept = [0.0], []

    def sleep(x):
        slept.append(round(x, 6))
        now[0] += x

    b = http.Bucket(2.0, 2, lambda: now[0], sleep)
    for _ in range(4):
        b.wait()
    assert slept == [0.5, 0.5]
    b.slow_to(5)
    assert (b.rate, b.burst) == (0.2, 1)
    b.slow_to(0.1)
    assert b.rate == 0.2
    limits = http.Limiters(1.0, 1, cap=10, idle_s=100, now=lambda: now[0], sleep=sleep)
    for i in range(40):
        limits.of(f"h{i}")
    assert len(limits.by) <= 10 and "h39" in limits.by


def test_live_crawl(spark, base):
    cfg = Config()
    cfg.crawler.concurrent_workers, cfg.crawler.per_host_rate_limit, cfg.crawler.global_rate_limit, cfg.content.quality_threshold = 2, 1e6, 1e6, 0.1
    out = crawl(spark, cfg, [base + "/"], http.live_fetcher(cfg), robots=http.live_robots(cfg), sitemaps=http.live_documents(cfg))
    # loopback hosts are blocked by default, so the seed itself must be let in
    assert out.stats["received"] == 0
    cfg.crawler.allowed_domains = ["127.0.0.1"]
    out = crawl(spark, cfg, [base + "/"], http.live_fetcher(cfg), robots=http.live_robots(cfg), sitemaps=http.live_documents(cfg))
    got = {r.url.removeprefix(base): r for r in out.results.collect()}
    assert sorted(got) == ["/", "/a", "/c", "/moved"] and got["/moved"].final_url == base + "/b" and out.stats["disallowed"] == 1


def test_command_line(spark, base, tmp_path, monkeypatch):
    file = tmp_path / "c.yaml"
    file.write_text("crawler:\n  allowed_domains: [127.0.0.1]\n  global_rate_limit: 100000\n  per_host_rate_limit: 100000\ncontent:\n  quality_threshold: 0.1\n  languages: []\n  deduplication:\n    enabled: false\n")
    args = ["--config", str(file), "--seed", base + "/", "--workers", "1", "--output", str(tmp_path / "out"), "--state", str(tmp_path / "state"), "--metrics", str(tmp_path / "m.json")]
    assert cli.main([*args, "--max-pages", "1"]) == 0 and spark.read.json(str(tmp_path / "out")).count() == 1
    assert cli.main([*args, "--max-pages", "10"]) == 0
    urls = sorted(r.url.removeprefix(base) for r in spark.read.json(str(tmp_path / "out")).select("url").collect())
    assert urls == ["/", "/a", "/moved"]
