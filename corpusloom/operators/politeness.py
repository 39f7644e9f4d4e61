"""Politeness: robots rules, request schedules, retries and backoff."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROBOTS_BYTES = 500 * 1024
RETRY_STATUS = (429, 500, 502, 503, 504)
RETRY_ERRORS = ("canceled", "connection_refused", "connection_reset", "deadline_exceeded", "dns_temporary", "eof", "net_timeout")

# robots.txt


def parse_robots(text: str) -> tuple[list[tuple[list[str], list[tuple[bool, str]], float]], list[str]]:
    """Groups ``(agents, [(allow, pattern)], delay)`` and sitemaps."""
    groups: list[tuple[list[str], list[tuple[bool, str]], list[float]]] = []
    sitemaps: list[str] = []
    fresh = True
    for line in text.lstrip("﻿").splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if fresh or not groups:
                groups.append(([], [], []))
                fresh = False
            groups[-1][0].append(value.lower())
        elif key == "sitemap":
            sitemaps.append(value)
        elif key in ("allow", "disallow", "crawl-delay") and groups:
            fresh = True
            if key == "crawl-delay":
                if re.fullmatch(r"\d+(\.\d+)?", value):
                    groups[-1][2].append(float(value))
            elif value:
                groups[-1][1].append((key == "allow", value))
    return [(a, r, d[0] if d else 0.0) for a, r, d in groups], sitemaps


def _hits(pattern: str, path: str) -> bool:
    end = pattern.endswith("$")
    body = ".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*")))
    return re.match(body + ("$" if end else ""), path, re.S) is not None


def robots_verdict(text: str | None, path: str, agent: str = "*") -> tuple[bool, int, str, list[str]]:
    """``(allowed, whole seconds of delay, pattern that forbids, sitemaps)``.

    The group that names the agent best counts, else "*"; of the patterns that match the longest
    decides, and between equals the one that allows.
    """
    groups, sitemaps = parse_robots(text or "")
    agent = agent.lower()
    named = [(max(len(a) for a in agents if a != "*" and a and agent.startswith(a)), i) for i, (agents, _, _) in enumerate(groups) if any(a != "*" and a and agent.startswith(a) for a in agents)]
    if named:
        best = max(n for n, _ in named)
        chosen = [groups[i] for n, i in named if n == best]
    else:
        chosen = [g for g in groups if "*" in g[0]]
    rules = [r for g in chosen for r in g[1]]
    delay = int(next((g[2] for g in chosen if g[2]), 0))
    found = [(len(p), allow, p) for allow, p in rules if _hits(p, path)]
    if not found:
        return True, delay, "", sitemaps
    _, allow, pattern = max(found)
    return allow, delay, "" if allow else pattern, sitemaps


def robots_url(host: Column) -> Column:
    return F.when(host.rlike("^https?://"), F.concat(F.regexp_replace(host, "/+$", ""), F.lit("/robots.txt"))).otherwise(F.concat(F.lit("http://"), host, F.lit("/robots.txt")))


def robots_table(raw: DataFrame, ttl_seconds: int = 86_400) -> DataFrame:
    """``robots(host, rules, error, fetched_at, expires_at)`` of ``raw(host, status, body, fetched_at)``.

    401, 403 and 404 allow all; other statuses and bodies of 500 KiB or more are errors.
    """
    big = F.octet_length(F.coalesce("body", F.lit(""))) >= ROBOTS_BYTES
    rules = F.when((F.col("status") == 200) & ~big, F.coalesce("body", F.lit(""))).when(F.col("status").isin(401, 403, 404), "")
    error = F.when(F.col("status").isNull(), "fetch").when((F.col("status") == 200) & big, "too_large").when(~F.col("status").isin(200, 401, 403, 404), "status")
    host = F.regexp_replace(F.lower("host"), ":[0-9]+$", "")
    out = raw.select(host.alias("host"), rules.alias("rules"), error.alias("error"), "fetched_at", (F.col("fetched_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))
    return out.groupBy("host").agg(F.max_by(F.struct("rules", "error", "fetched_at", "expires_at"), "fetched_at").alias("r")).select("host", "r.*")


def live(robots: DataFrame, now: Column | None = None) -> DataFrame:
    return robots.where(F.col("expires_at") > (now if now is not None else F.current_timestamp()))


def cache_stats(robots: DataFrame, now: Column) -> DataFrame:
    age = F.unix_timestamp(now) - F.unix_timestamp("fetched_at")
    return robots.agg(F.count("*").alias("entries"), F.count_if(F.col("expires_at") <= now).alias("expired"), F.min(age).alias("min_age_s"), F.max(age).alias("max_age_s"), F.avg(age).alias("avg_age_s"), F.lit(0.0).alias("hit_rate"))


def verdicts(rules: Column, path: Column, agent: str) -> Column:
    """``robots_verdict`` by Arrow batches."""

    @F.pandas_udf("allowed boolean, crawl_delay_s long, disallowed_by string, sitemaps array<string>")
    def run(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([robots_verdict(r, p, agent) for r, p in zip(texts, paths)], columns=["allowed", "crawl_delay_s", "disallowed_by", "sitemaps"])

    return run(rules, path)


def check_robots(urls: DataFrame, robots: DataFrame, agent: str = "*", url_col: str = "url") -> DataFrame:
    """Adds ``robots`` (allowed, crawl_delay_s, disallowed_by, sitemaps) and ``robots_error``.

    URLs of hosts without rules, or whose rules could not be had, are allowed.
    """
    from ..functions import urls as U

    u = F.col(url_col)
    path = F.when(U.part(u, 3) == "", "/").otherwise(U.part(u, 3))
    path = F.concat(path, F.when(U.part(u, 4) != "", F.concat(F.lit("?"), U.part(u, 4))).otherwise(""))
    rows = urls.withColumn("_host", F.lower(U.domain(u))).withColumn("_path", path)
    rows = rows.join(robots.select(F.col("host").alias("_host"), F.col("rules").alias("_rules"), F.col("error").alias("robots_error")), "_host", "left")
    return rows.withColumn("robots", verdicts(F.coalesce("_rules", F.lit("")), F.col("_path"), agent)).drop("_host", "_path", "_rules")


# schedules


def dispatch(requests: DataFrame, rate: float | str | Column, burst: int | Column, key: str = "host", arrival: str = "arrival_s", tie: str = "seq") -> DataFrame:
    """Adds ``dispatch_s``: when a token bucket of each key lets a request go.

    The n-th request of a key goes at ``max(arrival, m + (n + 1 - burst) / rate)`` with ``m`` the
    largest ``arrival - n / rate`` so far, which a running maximum gives without a loop.
    """
    rate = F.lit(rate) if isinstance(rate, float | int) else F.col(rate) if isinstance(rate, str) else rate
    burst = F.lit(burst) if isinstance(burst, int) else burst
    w = W.partitionBy(key).orderBy(arrival, tie)
    n = F.row_number().over(w) - 1
    rows = requests.withColumn("_n", n.cast("double")).withColumn("_lag", F.col(arrival) - F.col("_n") / rate)
    m = F.max("_lag").over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("dispatch_s", F.greatest(F.col(arrival), m + (F.col("_n") + 1) / rate - burst / rate)).drop("_n", "_lag")


def crawl_delay_rate(rate: Column, delay_s: Column) -> tuple[Column, Column]:
    """Rate and whether the burst falls to one: a delay only tightens."""
    tight = delay_s > 0
    return F.when(tight, F.least(rate, 1.0 / F.when(tight, delay_s))).otherwise(rate), tight


def evict(limiters: DataFrame, cap: int = 50_000, share: float = 0.9) -> DataFrame:
    """Limiters that stay: all up to ``cap``, else the ``share`` of it that was used last."""
    return limiters if limiters.count() < cap else limiters.orderBy(F.desc("last_used"), "host").limit(int(cap * share))


# retries


def exponential_delay_ms(attempt: Column, base: int = 500, factor: float = 2.0, cap: int = 30_000, jitter: Column | None = None) -> Column:
    raw = F.lit(float(base)) * F.pow(F.lit(factor), (attempt - 1).cast("double"))
    raw = raw * (1 + 0.1 * jitter) if jitter is not None else raw
    return F.when(attempt <= 0, 0).otherwise(F.least(raw, F.lit(float(cap)))).cast("long")


def linear_delay_ms(attempt: Column, base: int = 500, cap: int = 30_000) -> Column:
    return F.when(attempt <= 0, 0).otherwise(F.least(attempt.cast("long") * base, F.lit(cap))).cast("long")


def retryable_status(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRY_STATUS), F.lit(False))


def retryable_error(error: Column, more: Iterable[str] = ()) -> Column:
    return F.coalesce(error.isin(*RETRY_ERRORS, *more), F.lit(False))
