"""Structured Streaming: captured pages as they arrive, admitted and deduplicated with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions import urls as U
from ..operators import dedup
from ..operators.extract import Options, extract

PAGES = "url string, content_type string, body binary, fetched_at timestamp"


def pages(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """Captured pages from Parquet files; ``per_trigger`` files a batch hold back a fast source."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", per_trigger).parquet(path)


def admitted(stream: DataFrame, rules: U.Rules, watermark: str = "1 hour") -> DataFrame:
    """Valid URLs, each normal form once while its state lives."""
    rows = dedup.once(stream, normalized=U.normalize(F.col("url"))).where("normalized is not null")
    rows = rows.where(rules.reject_reason(F.col("normalized")).isNull())
    return rows.withWatermark("fetched_at", watermark).dropDuplicatesWithinWatermark(["normalized"])


def records(stream: DataFrame, options: Options = Options(), watermark: str | None = "1 hour") -> DataFrame:
    """Extracted pages above the quality gate, each clean text once while its state lives.

    ``watermark`` is None for a stream that has one, as ``admitted`` gives.
    """
    rows = extract(stream, options).where("reject_reason is null")
    rows = rows.withColumn("content_hash", dedup.content_hash(F.col("content.clean_text")))
    rows = rows.withWatermark("fetched_at", watermark) if watermark else rows
    return rows.dropDuplicatesWithinWatermark(["content_hash"]).drop("content_hash")


def write(rows: DataFrame, path: str, checkpoint: str):
    """Runs through what is there and stops; restarts go on from the checkpoint."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Keeps the latest counters of each query."""

    def __init__(self):
        self.latest: dict[str, dict] = {}

    def onQueryStarted(self, event):
        self.latest[str(event.id)] = {}

    def onQueryProgress(self, event):
        p = event.progress
        self.latest[str(p.id)] = {"batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond}

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.latest.pop(str(event.id), None)
