"""A breadth-first crawl as rounds of data frames over a pluggable fetcher.

Each round takes the frontier in order, fetches it, extracts, follows links and admits new URLs.
What a round leaves behind is written to the shared folder; the driver sees counts only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, extractor_options, url_rules
from ..functions import urls as U
from ..operators import dedup, metrics, politeness
from ..operators.extract import extract
from ..sources import tables
from . import corpus

SEED, SITEMAP, FOUND = 100, 50, 0
MAX_ATTEMPTS, MAX_HOPS = 2, 10
STATE_EVERY_S = 30.0

#: ``fetch(requests(url, attempt)) -> (url, status, content_type, body, final_url, redirect_chain, error, response_time_ms, rendered)``
Fetcher = Callable[[DataFrame], DataFrame]


def table_fetcher(pages: DataFrame, redirects: DataFrame | None = None) -> Fetcher:
    """Serves captured ``pages(url, status, content_type, body[, error, fail_attempts])`` by normalized URL.

    ``redirects(src, dst)`` are followed for MAX_HOPS hops; more give an error.  A page with
    ``fail_attempts`` fails with its ``error`` on that many attempts first.
    """
    served = pages.withColumn("_norm", U.normalize(F.col("url"))).drop("url")
    for name, kind in (("error", "string"), ("fail_attempts", "int")):
        if name not in served.columns:
            served = served.withColumn(name, F.lit(None).cast(kind))
    ends: list[DataFrame] = []

    def fetch(requests: DataFrame) -> DataFrame:
        asked = requests.select("url", "attempt", F.col("url").alias("final_url"), F.array().cast("array<string>").alias("redirect_chain"))
        if redirects is not None:
            if not ends:
                ends.append(redirect_ends(redirects))
            moved = asked.withColumn("_src", U.normalize(F.col("url"))).join(ends[0], "_src", "left")
            gone = F.col("_end").isNotNull()
            asked = moved.select("url", "attempt", F.when(gone, F.col("_end")).otherwise(F.col("url")).alias("final_url"), F.when(gone, F.concat(F.array("url"), "_path")).otherwise(F.col("redirect_chain")).alias("redirect_chain"))
        rows = asked.withColumn("_norm", U.normalize(F.col("final_url"))).join(served, "_norm", "left")
        lost = F.size("redirect_chain") > MAX_HOPS
        fails = F.col("error").isNotNull() & (F.col("attempt") < F.coalesce("fail_attempts", F.lit(1 << 30)))
        error = F.when(lost, "too_many_redirects").when(fails, F.col("error"))
        status = F.when(error.isNull(), F.coalesce("status", F.lit(404)))
        return rows.select("url", status.alias("status"), "content_type", "body", "final_url", "redirect_chain", error.alias("error"), F.lit(0).cast("long").alias("response_time_ms"), F.lit(False).alias("rendered"))

    return fetch


def redirect_ends(redirects: DataFrame) -> DataFrame:
    """``(_src, _end, _path)``: where ``redirects(src, dst)`` lead and the URLs between, MAX_HOPS + 1 hops at most.

    All chains advance by a hop at a time, until none moves.
    """
    hops = dedup.written(redirects.select(U.normalize(F.col("src")).alias("_at"), F.col("dst").alias("_next")), "hops")
    cur = hops.select(F.col("_at").alias("_src"), F.col("_next").alias("_end"), F.array().cast("array<string>").alias("_path"))
    for _ in range(MAX_HOPS):
        step = cur.withColumn("_at", U.normalize(F.col("_end"))).join(hops, "_at", "left")
        on = F.col("_next").isNotNull()
        step = dedup.written(step.select("_src", F.when(on, F.col("_next")).otherwise(F.col("_end")).alias("_end"), F.when(on, F.concat("_path", F.array("_end"))).otherwise(F.col("_path")).alias("_path"), on.alias("_on")), "hops")
        cur = step.drop("_on")
        if step.where("_on").isEmpty():
            break
    return cur


@dataclass
class Outcome:
    """Results of a crawl: one row a received result, pending items, and counters."""

    results: DataFrame
    pending: DataFrame
    stats: dict[str, int] = field(default_factory=dict)
    #: URLs that this run admitted, for a store that later runs read.
    seen: DataFrame | None = None


def ordered(frontier: DataFrame) -> list:
    """Highest priority, then least depth, then first come."""
    return [F.desc("priority"), "depth", "seq"]


def placed(frontier: DataFrame, name: str = "place") -> DataFrame:
    """``frontier`` with the place, from 1, at which each item is handed out; the order is to be total.

    Rows are sorted over ranges and numbered within them; the sizes of the ranges give what is added.
    """
    at = dedup.hidden("at")
    rows = dedup.written(frontier.orderBy(*ordered(frontier)).withColumn(at, F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned(at, 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each range
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["n"]
    offsets = frontier.sparkSession.createDataFrame(before, f"{at}_part long, {at}_before long")
    out = rows.join(F.broadcast(offsets), part == F.col(f"{at}_part"))
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, F.col(f"{at}_before") + inside + 1).drop(at, f"{at}_part", f"{at}_before")


def _admit(found: DataFrame, seen: DataFrame, rules, max_depth: int) -> DataFrame:
    """New items of ``found(url, depth, priority, seq)`` in normal form, first ones only."""
    if max_depth > 0:
        found = found.where(F.col("depth") <= max_depth)
    rows = dedup.once(found.withColumnRenamed("url", "_raw"), url=U.normalize(F.col("_raw"))).drop("_raw").where("url is not null")
    rows = rows.where(rules.reject_reason(F.col("url")).isNull())
    first = rows.groupBy("url").agg(F.min(F.struct(-F.col("priority"), "depth", "seq")).alias("m"))
    rows = first.select("url", F.col("m.depth").alias("depth"), (-F.col("m.col1")).alias("priority"), F.col("m.seq").alias("seq"))
    return rows.join(seen, "url", "left_anti")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


class Robots:
    """Robots rules from a table, or had for new hosts as they turn up by ``source(hosts) -> raw``."""

    def __init__(self, source, ttl_seconds: int):
        self.table = source if isinstance(source, DataFrame) else None
        self.source, self.ttl_seconds = source, ttl_seconds

    def of(self, urls: DataFrame) -> DataFrame:
        if isinstance(self.source, DataFrame):
            return self.source
        hosts = urls.select(F.lower(U.host(F.col("url"))).alias("host"), F.lower(U.domain(F.col("url"))).alias("_bare")).where("host is not null")
        hosts = hosts.groupBy("_bare").agg(F.min("host").alias("host"))  # rules are kept without a port
        if self.table is not None:
            hosts = hosts.join(politeness.live(self.table).select(F.col("host").alias("_bare")), "_bare", "left_anti")
        got = politeness.robots_table(self.source(hosts.select("host")), self.ttl_seconds)
        rows = got if self.table is None else got.unionByName(politeness.live(self.table))
        latest = rows.groupBy("host").agg(F.max_by(F.struct(*rows.columns[1:]), "fetched_at").alias("r"))
        self.table = dedup.written(latest.select("host", "r.*"), "robots")
        return self.table


def sitemap_documents(source, roots: DataFrame) -> DataFrame:
    """``(doc, body)`` of the roots and, one level down, of what they index, by ``source(docs) -> (doc, body)``."""
    first = dedup.written(source(roots.select("doc").distinct()), "sitemaps")
    below = tables.sitemap_locs(first).where("kind = 'sitemap'").select(F.col("loc").alias("doc")).distinct()
    return dedup.written(first.unionByName(source(below.join(first, "doc", "left_anti"))), "sitemaps")


def crawl(
    spark: SparkSession, cfg: Config, seeds, fetch: Fetcher, robots: DataFrame | Callable | None = None, sitemaps: DataFrame | Callable | None = None, seen: DataFrame | None = None, resume: DataFrame | None = None,
    headless: tuple[Fetcher, tuple[str, ...]] | None = None, earlier: DataFrame | None = None, on_state: Callable[[DataFrame, DataFrame, DataFrame], None] | None = None, state_every_s: float = STATE_EVERY_S,
    on_stats: Callable[[dict[str, int]], None] | None = None,
) -> Outcome:
    """Crawls from ``seeds`` until nothing is left or ``max_pages`` were dispatched.

    ``robots`` is a table as politeness.robots_table gives, or a function of hosts; ``sitemaps(doc, body)``,
    or a function of documents, turns sitemap discovery on; ``seen(url)`` holds URLs of earlier runs; ``resume`` pending items of one;
    ``headless`` another fetcher for the named hosts.  Filters act on the output only: links of
    duplicates and rejected pages are followed.

    ``on_state(pending, seen, results)`` is called between rounds, once ``state_every_s`` seconds have
    passed, with all pending items and what was seen and got since the last call; ``earlier`` holds such
    results of a run that was killed, which go through the output filters with this run's.
    ``on_stats`` gets the counters after each round.
    """
    rules, options, c = url_rules(cfg), extractor_options(cfg), cfg.crawler
    stats = {"dispatched": 0, "dropped": 0, "disallowed": 0, "retried": 0, "rounds": 0}
    rules_for = Robots(robots, cfg.robots.cache_duration_s) if robots is not None else None
    admitted: list[DataFrame] = []
    known = seen.select("url").distinct() if seen is not None else spark.createDataFrame([], "url string")
    empty = spark.createDataFrame([], tables.FRONTIER)
    frontier = empty
    if resume is not None:
        frontier = dedup.written(resume.select([x.split()[0] for x in tables.FRONTIER.split(", ")]), "frontier")
        known = known.union(frontier.select("url")).distinct()
    start = tables.seeds(spark, seeds) if not isinstance(seeds, DataFrame) else seeds
    found = start.select("url", F.lit(0).alias("depth"), F.lit(SEED).alias("priority"), "seq")
    if sitemaps is not None:
        roots = start.select(F.col("url").alias("seed"), tables.default_sitemap(F.col("url")).alias("doc"), F.lit(0).alias("pos"))
        if rules_for is not None:
            told = politeness.check_robots(start, rules_for.of(start), cfg.robots.user_agent).select(F.col("url").alias("seed"), F.posexplode("robots.sitemaps").alias("pos", "doc"))
            roots = told.select("seed", "doc", "pos").unionByName(roots.join(told, "seed", "left_anti"))
        listed = tables.discover(sitemaps if isinstance(sitemaps, DataFrame) else sitemap_documents(sitemaps, roots), roots)
        found = found.unionByName(listed.select(F.col("loc").alias("url"), F.lit(0).alias("depth"), F.lit(SITEMAP).alias("priority"), (F.lit(1 << 40) + F.col("pos")).alias("seq")))
    results: list[DataFrame] = [earlier] if earlier is not None else []
    past = (earlier.agg(F.max("round")).head()[0] or 0) if earlier is not None else 0
    unsaved: tuple[list[DataFrame], list[DataFrame]] = ([], [])
    saved_at = time.monotonic()
    new = _admit(found, known, rules, c.max_depth)
    while True:
        new = dedup.written(new.select("url", "depth", F.lit(0).alias("attempt"), F.lit(False).alias("retry"), "priority", "seq"), "new")
        admitted.append(new.select("url"))
        # what is known is a list of written parts, put together now and then
        known = known.union(new.select("url"))
        if len(admitted) >= 16:
            known = dedup.written(known, "seen")
            admitted = [dedup.written(_union(admitted), "admitted")]
        room = cfg.frontier.queue_capacity
        if room > 0:  # what does not fit is dropped, but counts as seen
            space, total = max(0, room - (0 if frontier is empty else frontier.count())), new.count()
            if total > space:
                stats["dropped"] += total - space
                new = dedup.written(new.orderBy(*ordered(new)).limit(space), "new")
        frontier = new if frontier is empty else dedup.written(frontier.unionByName(new), "frontier")
        if on_state is not None:
            unsaved[0].append(new.select("url"))
            if unsaved[1] and time.monotonic() - saved_at >= state_every_s:
                on_state(frontier, _union(unsaved[0]), _union(unsaved[1]))
                unsaved, saved_at = ([], []), time.monotonic()
        left = c.max_pages - stats["dispatched"]
        if left <= 0 or frontier.isEmpty():
            break
        # retries do not use up the cap
        fresh = frontier.where("not retry")
        n_fresh = fresh.count()
        if n_fresh > left:
            batch = dedup.written(fresh.orderBy(*ordered(fresh)).limit(left).unionByName(frontier.where("retry")), "batch")
            frontier = frontier.join(batch.select("url"), "url", "left_anti")
        else:
            batch, frontier = frontier, empty
        stats["dispatched"] += min(n_fresh, left)
        stats["rounds"] += 1
        sent = batch
        if rules_for is not None and cfg.robots.enabled:
            judged = politeness.check_robots(batch, rules_for.of(batch), cfg.robots.user_agent)
            sent = dedup.written(judged.where(F.coalesce(F.col("robots.allowed"), F.lit(True))).drop("robots", "robots_error"), "sent")
            stats["disallowed"] += batch.count() - sent.count()
        if headless is not None:
            other, hosts = headless
            mine = U.host(F.col("url")).isin(*hosts) if hosts else F.lit(True)
            got = fetch(sent.where(~mine)).unionByName(other(sent.where(mine)))
        else:
            got = fetch(sent)
        rows = sent.join(got, "url", "left")
        status_error = F.when(F.col("error").isNull() & ~F.col("status").between(200, 299), F.concat(F.lit("http_"), F.col("status").cast("string")))
        retryable = politeness.retryable_error(F.col("error")) | (status_error.isNotNull() & F.col("rendered") & politeness.retryable_status(F.col("status")))
        rows = rows.withColumn("retryable", retryable).withColumn("error", F.coalesce("error", status_error, F.when(F.col("status").isNull(), "no_response")))
        rows = extract(rows.withColumn("body", F.when(F.col("error").isNull(), F.col("body"))), options)
        # content that the gate rejects stays out of the record, its links do not
        content = F.when(F.col("error").isNull() & F.col("reject_reason").isNull(), F.col("content"))
        links = F.transform(F.coalesce(F.col("content.links"), F.array().cast("array<struct<url:string,text:string,title:string,rel:string,internal:boolean>>")), lambda x: x["url"])
        again = F.col("error").isNotNull() & F.col("retryable") & (F.col("attempt") < MAX_ATTEMPTS)
        rows = rows.select(
            "url", F.col("status").alias("status_code"), "content_type", links.alias("links"), content.alias("content"), "reject_reason", "error", "retryable", "final_url", "redirect_chain", "rendered", "response_time_ms",
            "depth", "attempt", "priority", "seq", F.lit(past + stats["rounds"]).alias("round"), F.col("error").isNull().alias("success"), again.alias("retried"), F.current_timestamp().alias("completed_at"),
        )
        rows = dedup.written(rows, "results")
        results.append(rows)
        if on_state is not None:
            unsaved[1].append(rows)
        if len(results) >= 16:  # a long crawl stays a union of few parts
            parts, results = results, [dedup.written(_union(results), "results")]
            if on_state is None:  # else these may have to be saved yet
                dedup.discard(*parts[:-1])
        back = rows.where("retried").select("url", "depth", (F.col("attempt") + 1).alias("attempt"), F.lit(True).alias("retry"), F.lit(FOUND).alias("priority"), "seq")
        n_back = back.count()
        stats["retried"] += n_back
        frontier = frontier.unionByName(back) if n_back else frontier
        # numbers follow the parents' order and then the place on the page
        kids = rows.select("priority", F.col("depth").alias("d"), "seq", F.posexplode("links").alias("pos", "url")).orderBy(F.desc("priority"), "d", "seq", "pos")
        kids = kids.select("url", (F.col("d") + 1).alias("depth"), F.lit(FOUND).alias("priority"), F.monotonically_increasing_id().alias("seq"))
        new = _admit(kids, known, rules, c.max_depth)
        if on_stats is not None:
            on_stats(dict(stats))
    own = _union(admitted)
    if not results:
        return Outcome(spark.createDataFrame([], "url string, success boolean, retried boolean, outcome string"), frontier, stats | dict.fromkeys(("received", "succeeded", "failed", "duplicate", "near_duplicate", "wrong_language"), 0), own)
    out = _union(results)
    d = cfg.content.deduplication
    final = out.where("not retried")
    key = F.struct("round", -F.col("priority"), "depth", "seq")
    final = final.withColumn("_text", F.col("content.clean_text")).withColumn("_lang", F.col("content.metadata.language")).withColumn("_order", key)
    final = corpus.classify(final, "url", "_text", "_lang", "_order", d.enabled and d.content_fingerprinting, d.enabled and d.semantic_similarity, tuple(cfg.content.languages), unique_ids=True)
    final = final.unionByName(out.where("retried"), allowMissingColumns=True).drop("_text", "_lang", "_order")
    final = dedup.written(final, "outcome")
    row = metrics.crawl_stats(final, stats["dispatched"], stats["dropped"]).head().asDict()
    return Outcome(final, frontier, stats | row, own)


def bfs_depths(edges: DataFrame, roots: DataFrame, max_depth: int = 0) -> DataFrame:
    """``(node, depth)``: least number of links from a root, by rounds over the new nodes only."""
    level = dedup.written(roots.select("node").distinct().withColumn("depth", F.lit(0)), "level")
    done, d = level, 0
    while (max_depth <= 0 or d < max_depth) and not level.isEmpty():
        d += 1
        nxt = level.join(edges, level.node == edges.src).select(F.col("dst").alias("node")).distinct()
        level = dedup.written(nxt.join(done.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "level")
        done = done.unionByName(level)
        if d % 16 == 0:
            done = dedup.written(done, "done")
    return done
