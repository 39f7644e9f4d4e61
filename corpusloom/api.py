"""The library's front: a crawl to records, and a crawl to JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .config import Config, load
from .plans import corpus
from .plans.crawl import Fetcher, Outcome, crawl, table_fetcher
from .sources import tables

__all__ = ["Config", "Fetcher", "Outcome", "crawl", "crawl_to_jsonl", "crawl_to_sink", "load", "table_fetcher"]


def crawl_to_sink(spark: SparkSession, cfg: Config, seeds, fetch: Fetcher, sink: Callable[[DataFrame], None], **more) -> dict[str, int]:
    """Crawls, hands the sink every final result that passes the output filters, and returns the counters."""
    out = crawl(spark, cfg, seeds, fetch, **more)
    if "content" in out.results.columns:
        sink(out.results.where("outcome = 'kept'"))
    return out.stats


def crawl_to_jsonl(spark: SparkSession, cfg: Config, seeds, fetch: Fetcher, path: str, append: bool = False, **more) -> dict[str, int]:
    return crawl_to_sink(spark, cfg, seeds, fetch, lambda rows: tables.write_jsonl(corpus.records(rows), path, append), **more)
