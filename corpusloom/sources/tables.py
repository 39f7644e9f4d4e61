"""Sources: seeds, captured pages, sitemaps, snapshots; and the sinks that match them."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FRONTIER = "url string, depth int, attempt int, retry boolean, priority int, seq long"
SITEMAP_DOCS, SITEMAP_URLS, SITEMAP_BYTES = 20, 5_000, 16 << 20
_STATE = "n long, pending string, seen array<string>, results array<string>"
#: Parts of seen URLs that are put together when there are more.
STATE_PARTS = 64
_SITEMAP = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"


def seeds(spark: SparkSession, urls: str | Iterable[str]) -> DataFrame:
    """``(url, seq)`` of a comma list or an iterable; blanks go; none at all is an error."""
    got = [u.strip() for u in (urls.split(",") if isinstance(urls, str) else urls)]
    got = [u for u in got if u]
    if not got:
        raise ValueError("no seed URLs")
    return spark.createDataFrame(list(zip(got, range(len(got)))), "url string, seq long")


def captured(df: DataFrame, content_type: str = "text/html; charset=utf-8") -> DataFrame:
    """``pages(page_id, url, html)`` as captured responses ``(url, status, content_type, body)``."""
    return df.select("url", F.lit(200).alias("status"), F.lit(content_type).alias("content_type"), F.encode("html", "UTF-8").alias("body"))


def sitemap_locs(docs: DataFrame) -> DataFrame:
    """``(doc, kind, pos, loc)`` of sitemap bodies ``(doc, body)``: kind ``url`` or ``sitemap``.

    Bodies over 16 MiB or that don't parse give nothing; locations are trimmed, blanks dropped.
    """
    x = docs.where(F.octet_length("body") <= SITEMAP_BYTES).select("doc", F.from_xml(F.col("body").cast("string"), _SITEMAP, {"mode": "PERMISSIVE"}).alias("x"))
    both = [x.select("doc", F.lit(k).alias("kind"), F.posexplode(f"x.{k}").alias("pos", "e")) for k in ("url", "sitemap")]
    rows = both[0].unionByName(both[1]).select("doc", "kind", "pos", F.trim(F.regexp_replace("e.loc", "^\\s+|\\s+$", "")).alias("loc"))
    return rows.where("loc != ''")


def discover(docs: DataFrame, roots: DataFrame, max_docs: int = SITEMAP_DOCS, max_urls: int = SITEMAP_URLS) -> DataFrame:
    """URLs ``(seed, loc)`` of each seed's sitemaps and, one level down, of those they index.

    ``roots(seed, doc, pos)`` are the sitemaps that robots rules declare, or the default place.  A
    child counts towards ``max_docs`` whether it can be read or not.
    """
    locs = sitemap_locs(docs)
    top = roots.select("seed", "doc").join(locs, "doc")
    # documents of a seed in reading order: the roots, then what they index
    children = top.where("kind = 'sitemap'").select("seed", F.col("loc").alias("doc"), F.col("pos").alias("cpos"))
    order = roots.select("seed", "doc", F.lit(0).alias("level"), F.col("pos").alias("a"), F.lit(0).alias("b"))
    order = order.unionByName(children.select("seed", "doc", F.lit(1).alias("level"), F.col("cpos").alias("a"), F.lit(0).alias("b")))
    w = W.partitionBy("seed").orderBy("level", "a", "b", "doc")
    used = order.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_docs)
    rows = used.join(locs.where("kind = 'url'"), "doc").withColumn("k", F.row_number().over(W.partitionBy("seed").orderBy("n", "pos")))
    return rows.where(F.col("k") <= max_urls).select("seed", "loc", F.col("k").alias("pos"))


def default_sitemap(url):
    """``scheme://host/sitemap.xml`` of a seed."""
    from ..functions import urls as U

    return F.concat(U.scheme(url), F.lit("://"), U.host(url), F.lit("/sitemap.xml"))


def save_snapshot(frontier: DataFrame, folder: str) -> str:
    """Writes pending items to a new folder, then moves the pointer ``CURRENT`` to it."""
    spark = frontier.sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    frontier.select("url", "depth", "attempt", "priority").write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").text(f"{folder}/CURRENT")
    return f"{folder}/{name}"


def load_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Pending items with fresh sequence numbers; the retry mark is lost."""
    name = spark.read.text(f"{folder}/CURRENT").head()[0]
    rows = spark.read.parquet(f"{folder}/{name}")
    return rows.select("url", "depth", "attempt", F.lit(False).alias("retry"), "priority", F.monotonically_increasing_id().alias("seq"))


def save_state(folder: str, pending: DataFrame, seen: DataFrame, results: DataFrame | None = None, done: bool = False) -> None:
    """Adds to the state of a crawl: what is pending now, and URLs seen and results got since the last call.

    The parts are written first and then a row that names all that count, so a run that is killed at
    any time goes on from the last such row.  With ``done`` results so far were put out and count no more.
    """
    spark = pending.sparkSession
    last = _last_state(spark, folder)
    n, mark = (last["n"] + 1 if last else 0), uuid.uuid4().hex
    seen_parts, result_parts = (list(last["seen"]), list(last["results"])) if last else ([], [])
    pending.select("url", "depth", "attempt", "priority").write.parquet(f"{folder}/pending-{mark}")
    seen.select("url").write.parquet(f"{folder}/seen-{mark}")
    seen_parts.append(f"seen-{mark}")
    if len(seen_parts) > STATE_PARTS:
        spark.read.parquet(*[f"{folder}/{x}" for x in seen_parts]).distinct().write.parquet(f"{folder}/seen-{mark}-all")
        seen_parts = [f"seen-{mark}-all"]
    if done:
        result_parts = []
    elif results is not None:
        results.write.parquet(f"{folder}/results-{mark}")
        result_parts.append(f"results-{mark}")
    row = [(n, f"pending-{mark}", seen_parts, result_parts)]
    spark.createDataFrame(row, _STATE).coalesce(1).write.mode("append").json(f"{folder}/states")


def load_state(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame | None] | None:
    """``(pending, seen, results)`` of the last state, or None in a new folder; pending items get fresh sequence numbers.

    ``results`` are those of a killed run that were not put out yet, None if there are none.
    """
    last = _last_state(spark, folder)
    if last is None:
        return None
    pending = spark.read.parquet(f"{folder}/{last['pending']}")
    pending = pending.select("url", "depth", "attempt", F.lit(False).alias("retry"), "priority", F.monotonically_increasing_id().alias("seq"))
    seen = spark.read.parquet(*[f"{folder}/{x}" for x in last["seen"]])
    return pending, seen, spark.read.parquet(*[f"{folder}/{x}" for x in last["results"]]) if last["results"] else None


def _last_state(spark: SparkSession, folder: str):
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(_STATE).json(f"{folder}/states").orderBy(F.desc("n")).head()
    except AnalysisException as e:  # a new folder
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Pending items of a JSON array file."""
    return spark.read.schema("url string, depth int, attempt int, priority int").json(path, multiLine=True)


def write_items(frontier: DataFrame, path: str) -> None:
    """Pending items as JSON lines, for other tools."""
    frontier.select("url", "depth", "attempt", "priority").write.mode("overwrite").json(path)


def write_jsonl(records: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line; null fields are left out."""
    records.write.mode("append" if append else "overwrite").option("ignoreNullFields", True).json(path)


def write_parquet(records: DataFrame, path: str, append: bool = False, by: tuple[str, ...] = ()) -> None:
    out = records.write.mode("append" if append else "overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)
