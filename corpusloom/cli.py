"""Command line: a crawl from seeds to JSON lines, with state that a later run goes on from."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__
from .api import crawl, load
from .plans import corpus
from .plans.crawl import STATE_EVERY_S
from .sources import http, tables


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("corpusloom", description=__doc__)
    p.add_argument("--config", help="YAML or JSON file")
    p.add_argument("--seed", help="URLs with commas between them; wins over the file")
    p.add_argument("--workers", type=int, help="fetching tasks")
    p.add_argument("--max-pages", type=int)
    p.add_argument("--max-depth", type=int)
    p.add_argument("--output", default="output", help="folder for JSON lines")
    p.add_argument("--timeout", type=float, help="seconds for a request")
    p.add_argument("--sitemap", action="store_true", help="start from sitemaps too")
    p.add_argument("--state", help="folder of seen URLs and pending items, from which a stopped or killed run goes on; output is appended then")
    p.add_argument("--state-every", type=float, default=STATE_EVERY_S, help="seconds between states")
    p.add_argument("--metrics", help="file for the counters, as JSON")
    p.add_argument("--js", action="store_true", help="ask for rendered pages; no renderer is built in, so pages are fetched plainly")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    a = arguments(argv)
    flags = {"crawler.seed_urls": a.seed, "crawler.concurrent_workers": a.workers, "crawler.max_pages": a.max_pages, "crawler.max_depth": a.max_depth, "crawler.request_timeout_s": a.timeout, "features.javascript_rendering": a.js or None}
    cfg = load(a.config, {k: v for k, v in flags.items() if v is not None})
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if cfg.features.javascript_rendering:
        print("no renderer is built in; pages are fetched plainly", file=sys.stderr)
    state = tables.load_state(spark, a.state) if a.state else None
    resume, seen, earlier = state or (None, None, None)
    save = (lambda pending, seen, results: tables.save_state(a.state, pending, seen, results)) if a.state else None
    stats = (lambda row: print(json.dumps(row), file=sys.stderr)) if a.verbose else None
    out = crawl(
        spark, cfg, cfg.crawler.seed_urls, http.live_fetcher(cfg), robots=http.live_robots(cfg) if cfg.robots.enabled else None, sitemaps=http.live_documents(cfg) if a.sitemap else None,
        seen=seen, resume=resume, earlier=earlier, on_state=save, state_every_s=a.state_every, on_stats=stats,
    )
    if "content" in out.results.columns:
        tables.write_jsonl(corpus.records(out.results.where("outcome = 'kept'")), a.output, append=bool(a.state))
    if a.state:
        tables.save_state(a.state, out.pending, out.seen, done=True)
    if a.metrics:
        with open(a.metrics, "w", encoding="utf-8") as f:
            json.dump(out.stats, f)
    if a.verbose:
        print(json.dumps(out.stats), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
