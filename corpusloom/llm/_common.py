"""Shared helpers: the cluster's shared folder, staged tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges at one node over which a round of components sends that node's minimum to all tasks.
HOT_NODE = 200_000
#: Hot nodes and keys that are sent to all tasks at most, the hottest first; any other has at most 1 / HOT_KEYS of the rows.
HOT_KEYS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a session in one process (``local[...]``, as in tests) may do without the setting; it gets a
    temporary folder for its lifetime.  On a cluster a missing setting raises ValueError, as rows in
    machine-local folders would be lost.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusloom.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("corpusloom.shared.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later failures reread files that survive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name() -> str:
    """A column name that no caller has."""
    return f"c_{uuid.uuid4().hex}"


def _with_low(rows: DataFrame, low: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` with the minimum ``m`` of their node ``a``; minima of hot nodes are broadcast, so no task gets all rows of one."""
    if hot is None:
        return rows.join(low, "a")
    hot = F.broadcast(hot)
    return rows.join(hot, "a", "left_anti").join(low.join(hot, "a", "left_anti"), "a").unionByName(rows.join(F.broadcast(low.join(hot, "a", "left_semi")), "a"))


def components(edges: DataFrame, hot_node: int = HOT_NODE) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star rounds.

    Returns ``(node, root)`` with the smallest node of each component as its root, for every node
    with an edge to another one but the roots themselves.  Null ends and self loops are ignored; an empty table gives an
    empty result.  Each round is written to the shared folder, so a lost executor costs one round
    at most; what earlier rounds wrote is deleted.  Of nodes with over ``hot_node`` edges the HOT_KEYS
    hottest are joined by a broadcast of their minima.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    cur = staged(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = cur.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1000003)).head()
        if tuple(mark) == seen or not mark[0]:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, last, hot = tuple(mark), cur, None
        sym = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if mark[0] > hot_node:
            hot = staged(sym.groupBy("a").count().where(F.col("count") > hot_node).orderBy(F.desc("count"), "a").limit(HOT_KEYS).select("a"), "hot-nodes")
            hot = None if hot.isEmpty() else hot
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _with_low(sym.where("b > a"), low, hot).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_low(large, low, hot).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).distinct()
        cur = staged(small, "edges")
        discard(last, hot)
