"""Counters of a crawl, of workers, of admission and of domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def crawl_stats(results: DataFrame, dispatched: int | None = None, dropped: int = 0) -> DataFrame:
    """One row of counters from ``results(success, retried, outcome)``."""
    c = F.count_if
    return results.agg(
        (F.lit(dispatched).cast("long") if dispatched is not None else F.count("*")).alias("dispatched"), F.count("*").alias("received"), c(F.col("success")).alias("succeeded"),
        c(~F.col("success") & ~F.col("retried")).alias("failed"), c(F.col("outcome") == "duplicate").alias("duplicate"), c(F.col("outcome") == "near_duplicate").alias("near_duplicate"),
        c(F.col("retried")).alias("retried"), F.lit(dropped).cast("long").alias("dropped"), c(F.col("outcome") == "wrong_language").alias("wrong_language"),
    )


def engine_metrics(results: DataFrame, uptime_s: float) -> DataFrame:
    """Totals, jobs a second, mean latency and error rate in per cent."""
    n = F.count("*")
    return results.agg(
        n.alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), (n / F.lit(float(uptime_s))).alias("jobs_per_s"),
        F.avg("response_time_ms").alias("avg_latency_ms"), (F.when(n > 0, F.count_if(~F.col("success")) / n * 100.0).otherwise(0.0)).alias("error_rate"),
    )


def worker_stats(results: DataFrame, worker: str = "worker_id", latency: str = "response_time_ms") -> DataFrame:
    return results.groupBy(worker).agg(F.count("*").alias("jobs"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.avg(latency).alias("avg_latency"))


def admission_stats(admitted: DataFrame) -> DataFrame:
    c = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return admitted.agg(F.count("*").alias("processed"), c("valid"), c("duplicate"), c("invalid"))


def domain_stats(rows: DataFrame, url_col: str = "url", success=None) -> DataFrame:
    """``domain, subdomain, tld, is_ip`` with counts of URLs, successes and errors."""
    ok = success if success is not None else F.lit(True)
    d = U.domain(F.col(url_col))
    out = rows.withColumn("domain", d).where("domain is not null").groupBy("domain").agg(F.count("*").alias("url_count"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("error_count"))
    d = F.col("domain")
    return out.select("domain", U.subdomain(d).alias("subdomain"), U.top_level(d).alias("tld"), U.is_ip(d).alias("is_ip"), "url_count", "success_count", "error_count")
