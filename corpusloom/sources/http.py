"""Live HTTP: a client with retries and middleware, and fetchers that run it inside tasks.

Requests are dealt by host, so the limiter of a host lives in one task.  Redirects are followed here,
hop by hop, and each hop asks the rules of its host and waits for its limiter.
"""

from __future__ import annotations

import http.client
import socket
import ssl
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.politeness import RETRY_ERRORS, RETRY_STATUS, ROBOTS_BYTES, robots_verdict

AGENT = "corpusloom/1.0"
MAX_HOPS = 10
RESULT = "url string, status int, content_type string, body binary, final_url string, redirect_chain array<string>, error string, response_time_ms long, rendered boolean"


class FetchError(Exception):
    """``kind`` is one of the names that retry rules know, or another one."""

    def __init__(self, kind: str, text: str = ""):
        super().__init__(text or kind)
        self.kind = kind


@dataclass(frozen=True)
class Request:
    url: str
    method: str = "GET"
    headers: dict = field(default_factory=dict)
    body: bytes | None = None
    timeout_s: float = 30.0


@dataclass(frozen=True)
class Reply:
    status: int
    headers: dict
    body: bytes


Handler = Callable[[Request], Reply]
Middleware = Callable[[Handler], Handler]


def transport(request: Request) -> Reply:
    """One exchange without redirects; network errors become FetchError."""
    u = urlsplit(request.url)
    if u.scheme not in ("http", "https") or not u.hostname:
        raise FetchError("bad_url", request.url)
    path = (u.path or "/") + (f"?{u.query}" if u.query else "")
    make = http.client.HTTPSConnection if u.scheme == "https" else http.client.HTTPConnection
    link = make(u.hostname, u.port, timeout=request.timeout_s)
    try:
        link.request(request.method, path, request.body, request.headers)
        got = link.getresponse()
        return Reply(got.status, {k.lower(): v for k, v in got.getheaders()}, got.read())
    except ConnectionRefusedError as e:
        raise FetchError("connection_refused", str(e)) from e
    except (http.client.RemoteDisconnected, http.client.IncompleteRead) as e:
        raise FetchError("eof", str(e)) from e
    except (ConnectionResetError, BrokenPipeError) as e:
        raise FetchError("connection_reset", str(e)) from e
    except TimeoutError as e:
        raise FetchError("net_timeout", str(e)) from e
    except socket.gaierror as e:
        raise FetchError("dns_temporary" if e.errno == socket.EAI_AGAIN else "dns", str(e)) from e
    except (ssl.SSLError, http.client.HTTPException, OSError, ValueError) as e:
        raise FetchError("transport", str(e)) from e
    finally:
        link.close()


# middleware; the first one is outermost


def with_agent(agent: str) -> Middleware:
    return lambda handler: lambda r: handler(replace(r, headers={"User-Agent": agent} | r.headers))


def with_timeout(seconds: float) -> Middleware:
    return lambda handler: lambda r: handler(replace(r, timeout_s=seconds))


def with_log(write: Callable[[str], None]) -> Middleware:
    def wrap(handler: Handler) -> Handler:
        def run(r: Request) -> Reply:
            try:
                got = handler(r)
            except FetchError as e:
                write(f"{r.method} {r.url} {e.kind}")
                raise
            write(f"{r.method} {r.url} {got.status}")
            return got

        return run

    return wrap


@dataclass
class Counters:
    requests: int = 0
    errors: int = 0
    seconds: float = 0.0


def with_counters(counters: Counters) -> Middleware:
    def wrap(handler: Handler) -> Handler:
        def run(r: Request) -> Reply:
            began = time.monotonic()
            counters.requests += 1
            try:
                return handler(r)
            except FetchError:
                counters.errors += 1
                raise
            finally:
                counters.seconds += time.monotonic() - began

        return run

    return wrap


class Bucket:
    """Token bucket; ``slow_to`` only ever tightens it."""

    def __init__(self, rate: float, burst: int, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.now, self.sleep = rate, burst, now, sleep
        self.tokens, self.at, self.used = float(burst), now(), now()

    def wait(self) -> None:
        t = self.now()
        self.tokens = min(self.burst, self.tokens + (t - self.at) * self.rate)
        self.at = self.used = t
        self.tokens -= 1
        if self.tokens < 0:
            self.sleep(-self.tokens / self.rate)

    def slow_to(self, delay_s: float) -> None:
        if delay_s > 0:
            self.rate, self.burst = min(self.rate, 1.0 / delay_s), 1
            self.tokens = min(self.tokens, 1.0)


class Limiters:
    """A bucket for each host, and one over all; idle ones go, and the longest unused beyond ``cap``."""

    def __init__(self, rate: float, burst: int, all_rate: float = 0.0, all_burst: int = 1, cap: int = 50_000, idle_s: float = 900.0, **clock):
        self.rate, self.burst, self.cap, self.idle_s, self.clock = rate, burst, cap, idle_s, clock
        self.by: dict[str, Bucket] = {}
        self.over_all = Bucket(all_rate, all_burst, **clock) if all_rate > 0 else None

    def of(self, host: str) -> Bucket:
        if host not in self.by:
            if len(self.by) >= self.cap:
                self.tidy()
                for h in sorted(self.by, key=lambda h: self.by[h].used)[: max(0, len(self.by) - int(self.cap * 0.9) + 1)]:
                    del self.by[h]
            self.by[host] = Bucket(self.rate, self.burst, **self.clock)
        return self.by[host]

    def tidy(self) -> None:
        old = self.clock.get("now", time.monotonic)() - self.idle_s
        self.by = {h: b for h, b in self.by.items() if b.used >= old}

    def wait(self, host: str) -> None:
        if self.over_all:
            self.over_all.wait()
        self.of(host).wait()


def with_limits(limits: Limiters, per_host: bool = True) -> Middleware:
    def wrap(handler: Handler) -> Handler:
        def run(r: Request) -> Reply:
            limits.wait((urlsplit(r.url).hostname or "") if per_host else "")
            return handler(r)

        return run

    return wrap


@dataclass(frozen=True)
class Retry:
    """``kind`` is ``exponential`` or ``linear``; delays in milliseconds."""

    most: int = 3
    base_ms: float = 500.0
    factor: float = 2.0
    cap_ms: float = 30_000.0
    kind: str = "exponential"
    status: tuple[int, ...] = RETRY_STATUS
    errors: tuple[str, ...] = RETRY_ERRORS

    def delay_ms(self, attempt: int) -> float:
        if attempt <= 0:
            return 0.0
        return min(self.cap_ms, self.base_ms * (self.factor ** (attempt - 1) if self.kind == "exponential" else attempt))


class Client:
    """Up to ``1 + retry.most`` attempts; a retryable status that stays is an error."""

    def __init__(self, retry: Retry = Retry(), middleware: Iterable[Middleware] = (), send: Handler = transport, sleep: Callable[[float], None] = time.sleep):
        self.retry, self.sleep, self.send = retry, sleep, send
        self.chain: list[Middleware] = [*middleware]

    def add(self, m: Middleware) -> None:
        self.chain.append(m)

    def do(self, request: Request) -> Reply:
        handler = self.send
        for m in reversed([*self.chain, with_agent(AGENT)]):
            handler = m(handler)
        for attempt in range(self.retry.most + 1):
            last = attempt == self.retry.most
            try:
                got = handler(request)
            except FetchError as e:
                if last or e.kind not in self.retry.errors:
                    raise
            else:
                if got.status not in self.retry.status:
                    return got
                if last:
                    raise FetchError(f"http_{got.status}", f"status {got.status} after {attempt + 1} attempts")
            self.sleep(self.retry.delay_ms(attempt + 1) / 1000)
        raise AssertionError("unreachable")

    def get(self, url: str, **headers: str) -> Reply:
        return self.do(Request(url, headers=headers))

    def head(self, url: str, **headers: str) -> Reply:
        return self.do(Request(url, "HEAD", headers))

    def post(self, url: str, body: bytes, content_type: str = "application/octet-stream", **headers: str) -> Reply:
        return self.do(Request(url, "POST", {"Content-Type": content_type} | headers, body))


class Session:
    """What a task holds: a client, limiters and the robots rules of the hosts that redirects lead to."""

    def __init__(self, client: Client, limits: Limiters, agent: str = "*", robots: bool = True):
        self.client, self.limits, self.agent, self.robots = client, limits, agent, robots
        self.rules: dict[str, str] = {}

    def govern(self, url: str) -> None:
        u = urlsplit(url)
        host = u.netloc.rpartition("@")[2]
        bucket = self.limits.of(host)
        if self.robots:
            name = (u.hostname or "").lower()
            if name not in self.rules:
                self.rules[name] = rules_of(*robots_text(self.client, host))
            allowed, delay, _, _ = robots_verdict(self.rules[name], (u.path or "/") + (f"?{u.query}" if u.query else ""), self.agent)
            if not allowed:
                raise FetchError("robots_disallowed", url)
            bucket.slow_to(delay)
        self.limits.wait(host)

    def fetch(self, url: str) -> tuple[Reply, str, list[str]]:
        """Reply, final URL and the URLs before it, over up to MAX_HOPS redirects."""
        chain: list[str] = []
        at = url
        for _ in range(MAX_HOPS + 1):
            self.govern(at)
            got = self.client.get(at)
            if not 300 <= got.status < 400:
                return got, at, chain
            to = got.headers.get("location")
            if not to:
                raise FetchError("redirect_without_location", at)
            chain.append(at)
            at = urljoin(at, to)
        raise FetchError("too_many_redirects", url)


def robots_text(client: Client, host: str) -> tuple[int | None, str | None]:
    try:
        got = client.get(f"http://{host}/robots.txt")
    except FetchError:
        return None, None
    return got.status, got.body.decode("utf-8", "replace")


def rules_of(status: int | None, body: str | None) -> str:
    """Rules that a reply gives; what can't be had allows all."""
    return body if status == 200 and body is not None and len(body.encode()) < ROBOTS_BYTES else ""


def _session(cfg, parts: int) -> Session:
    c, h = cfg.crawler, cfg.http
    client = Client(Retry(h.max_retries, h.base_delay_ms, h.multiplier, h.max_delay_ms), [with_agent(AGENT), with_timeout(c.request_timeout_s)])
    return Session(client, Limiters(c.per_host_rate_limit, c.per_host_rate_burst, c.global_rate_limit / parts, max(1, c.global_rate_burst // parts)), cfg.robots.user_agent, cfg.robots.enabled)


def live_fetcher(cfg):
    """A fetcher over the network, in ``cfg.crawler.concurrent_workers`` tasks; a host lies in one of them.

    The limit over all hosts is shared out evenly to the tasks.
    """
    parts = max(1, cfg.crawler.concurrent_workers)
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = _session(cfg, parts)
        for b in batches:
            for url in b.column(0).to_pylist():
                began = time.monotonic()
                try:
                    got, final, chain = session.fetch(url)
                    row = (url, got.status, got.headers.get("content-type"), got.body, final, chain, None)
                except FetchError as e:
                    row = (url, None, None, None, url, [], e.kind)
                row += (int(1000 * (time.monotonic() - began)), False)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    def fetch(requests: DataFrame) -> DataFrame:
        dealt = requests.select("url", U.host(F.col("url")).alias("_host")).repartition(parts, "_host")
        return dealt.select("url").mapInArrow(run, RESULT)

    return fetch


def live_robots(cfg):
    """``hosts(host) -> raw(host, status, body, fetched_at)`` for ``politeness.robots_table``."""

    def run(batches):
        session = _session(cfg, 1)
        for b in batches:
            hosts = b.column(0).to_pylist()
            got = [robots_text(session.client, h) for h in hosts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in got], pa.int32()), pa.array([t for _, t in got], pa.string())], ["host", "status", "body"])

    return lambda hosts: hosts.select("host").mapInArrow(run, "host string, status int, body string").withColumn("fetched_at", F.current_timestamp())


def live_documents(cfg):
    """``docs(doc) -> (doc, body)`` of what can be had with a 2xx status, for sitemap discovery."""

    def run(batches):
        session = _session(cfg, 1)
        for b in batches:
            for doc in b.column(0).to_pylist():
                try:
                    got = session.fetch(doc)[0]
                except FetchError:
                    continue
                if 200 <= got.status < 300:
                    yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([got.body], pa.binary())], ["doc", "body"])

    return lambda docs: docs.select("doc").mapInArrow(run, "doc string, body binary")
