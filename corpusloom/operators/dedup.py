"""Duplicate removal for output: exact first-wins, then greedy near duplicates.

Order is always an explicit column.  Of equal content the first row is kept.  A near duplicate is
dropped if an earlier *kept* row is within a few fingerprint bits, so a row near a dropped one only
is kept.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NEAR_BITS = 3
_BASIS, _PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)


def scratch_folder(spark) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share.

    Only a session in one process (``local[...]``) may do without the setting; on a cluster a missing
    setting raises ValueError, as rows in machine-local folders would be lost.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusloom.scratch.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("corpusloom.scratch.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of written frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "written_path", None)
        if path:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def hidden(name: str) -> str:
    """A column name that no caller has."""
    return f"{name}_{uuid.uuid4().hex}"


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that are worked out once a row: plain projections would be merged into each later use."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def content_hash(c: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text."""
    return F.sha2(F.encode(c, "UTF-8"), 256)


def _fnv(grams: np.ndarray) -> np.ndarray:
    h = np.full(len(grams), _BASIS)
    with np.errstate(over="ignore"):
        for k in range(grams.shape[1]):
            h = (h ^ grams[:, k]) * _PRIME
    return h


def fold(text: str) -> str:
    """White-space runs as one space, none in front, one at the end if there was any; lower case by character."""
    body = " ".join(text.split())
    if not body:
        return ""
    if text[-1].isspace():
        body += " "
    return body.lower() if body.isascii() else "".join([(low if len(low := ch.lower()) == 1 else ch) for ch in body])


def simhash_of(text: str | None) -> int:
    """Unsigned fingerprint over byte 3-grams of the folded text; 0 for none."""
    if not text:
        return 0
    data = np.frombuffer(fold(text).encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < 3:
        return int(_fnv(data.reshape(1, -1).astype(np.uint64))[0])
    code = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
    seen, times = np.unique(code, return_counts=True)
    grams = np.stack([(seen >> 16) & 255, (seen >> 8) & 255, seen & 255], axis=1).astype(np.uint64)
    bits = np.unpackbits(_fnv(grams).view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.int64)
    votes = times @ bits
    return int(np.packbits(votes * 2 > times.sum(), bitorder="little").view("<u8")[0])


def simhash(c: Column | str) -> Column:
    """Fingerprint as a signed long, by Arrow batches; null gives 0."""

    @F.pandas_udf("long")
    def run(text):
        import pandas as pd

        return pd.Series(np.array([simhash_of(t) for t in text], np.uint64).view(np.int64), index=text.index)

    return run(c)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Keys with over HOT_ROWS rows are hot; the HOT_KEYS hottest are broadcast, so any other has at most 1 / HOT_KEYS of the rows.
HOT_ROWS, HOT_KEYS = 100_000, 1000


def looked_up(rows: DataFrame, keys: DataFrame, on: str, weight: str, spread: Column, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with a struct ``value`` of the other columns of ``keys``, which has one row a key; null where there is none.

    The hottest keys by ``weight`` are broadcast, HOT_KEYS at most, and only the others are shuffled to.
    Rows of hot and of null keys are spread by ``spread``, which should differ from row to row.
    """
    salt, warm, cold = hidden("salt"), hidden("warm"), hidden("cold")
    held = F.struct(*[c for c in keys.columns if c != on])
    hot = keys.where(F.col(weight) > hot_rows).orderBy(F.desc(weight), on).limit(HOT_KEYS).select(on, held.alias(warm))
    out = rows.join(F.broadcast(hot), on, "left")
    out = out.withColumn(salt, F.when(F.col(warm).isNotNull() | F.col(on).isNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("long")))
    rest = keys.select(on, F.lit(0).cast("long").alias(salt), held.alias(cold))
    return out.join(rest, [on, salt], "left").withColumn(value, F.coalesce(warm, cold)).drop(salt, warm, cold)


def first_wins(df: DataFrame, key: Column, order: list, flag: str = "is_first", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Flags the first row of each key by an order, which is to be total: rows that tie on it are all first.

    The first row comes from an aggregate that is combined before the shuffle, and a lookup of keys
    with several rows, so a key with many rows isn't gathered in one task.  Null keys are never duplicates.
    """
    k, o, n, m, v = (hidden(x) for x in ("key", "order", "rows", "first", "found"))
    keyed = df.withColumns({k: key, o: F.struct(*order)})
    first = keyed.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(o).alias(m), F.count("*").alias(n)).where(F.col(n) > 1)
    found = looked_up(keyed, first, k, n, F.col(o), v, hot_rows)
    return found.withColumn(flag, F.col(v).isNull() | (F.col(o) == F.col(v)[m])).drop(k, o, v)


#: Distinct fingerprints for which ``near_pairs`` opens one more task.
PAIR_ROWS = 2000

#: Bits of the five blocks of a fingerprint: within three bits, at least two blocks are equal.
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_BLOCK_PAIRS = tuple((i, j) for i in range(5) for j in range(i + 1, 5))


def _block(fp: Column, i: int) -> Column:
    at, size = _BLOCKS[i]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << size) - 1))


def bands(fp: Column) -> Column:
    """Ten keys of a fingerprint, one for each pair of its blocks; within three bits one of them is equal."""
    return F.array(*[F.shiftleft(_block(fp, i), 17).bitwiseOR(F.shiftleft(_block(fp, j), 4)).bitwiseOR(F.lit(k)) for k, (i, j) in enumerate(_BLOCK_PAIRS)])


def near_pairs(df: DataFrame, id_col: str = "id", fp_col: str = "fp", order_col: str = "seq", bits: int = NEAR_BITS) -> DataFrame:
    """``(earlier, later)`` ids within ``bits`` bits, from rows of distinct fingerprints.

    Each pair comes from its first two equal blocks, so no distinct is needed.  A key has 25 or 26
    bits, so among n spread fingerprints one meets n / 2^25 others by it.
    """
    if bits > 3:
        raise ValueError("pairs of five blocks find at most three differing bits")
    rows = df.select(F.col(id_col).alias("id"), F.col(fp_col).alias("fp"), F.col(order_col).alias("o"), F.explode(bands(F.col(fp_col))).alias("band"))
    tasks = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // PAIR_ROWS + 1)
    rows = rows.repartition(tasks, "band")  # by their bytes few tasks would get them all, but work grows with pairs
    a, b = rows.alias("a"), rows.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    k = F.col("a.band").bitwiseAND(F.lit(15))
    first = F.lit(False)
    for n, (i, j) in enumerate(_BLOCK_PAIRS):
        differ = F.lit(True)
        for p in range(j):
            if p != i:
                differ = differ & (_block(x, p) != 0)
        first = first | ((k == n) & differ)
    joined = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.o") < F.col("b.o")) & (F.bit_count(x) <= bits) & first)
    return joined.select(F.col("a.id").alias("earlier"), F.col("b.id").alias("later"))


def greedy_keep(df: DataFrame, id_col: str = "id", fp_col: str = "fp", order_col: str = "seq", bits: int = NEAR_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, near_duplicate)``: dropped are rows within ``bits`` bits of an earlier kept row.

    Rounds settle rows whose earlier neighbours are settled: dropped if one is kept, kept if all are
    dropped.  Rows with equal fingerprints never outlast their first, so the rounds run over first
    rows only.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(fp_col).alias("fp"), F.col(order_col).alias("o"))
    lead = rows.groupBy("fp").agg(F.min(F.struct("o", "id")).alias("m"), F.count("*").alias("n")).select("fp", F.col("m.o").alias("o"), F.col("m.id").alias("id"), "n")
    lead = written(lead, "leaders")
    edges = written(near_pairs(lead, "id", "fp", "o", bits), "near")
    open_ = edges
    settled = lead.join(edges.select(F.col("later").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("kept"))
    while not open_.isEmpty():
        named = open_.join(settled.select(F.col("id").alias("earlier"), "kept"), "earlier", "left")
        state = named.groupBy("later").agg(F.max(F.coalesce("kept", F.lit(False)).cast("int")).alias("near"), F.count(F.when(F.col("kept").isNull(), 1)).alias("left"))
        done = state.where("near = 1 or left = 0").select(F.col("later").alias("id"), (F.col("near") == 0).alias("kept"))
        before, last = settled, open_
        settled = written(settled.unionByName(done), "settled")
        open_ = written(open_.join(settled.select(F.col("id").alias("later")), "later", "left_anti"), "open")
        discard(before, last if last is not edges else None)
    led = written(lead.select("fp", F.col("id").alias("lead"), "n").join(settled.select(F.col("id").alias("lead"), "kept"), "lead"), "led")
    out = looked_up(rows, led, "fp", "n", F.struct("o", "id"), "led", hot_rows)
    return out.select("id", ((F.col("id") != F.col("led.lead")) | ~F.col("led.kept")).alias("near_duplicate"))


def seen_filter(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``seen``: the lookup in an outside store, as an anti join."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def remember(df: DataFrame, path: str, hash_type: str, hash_col: str, url_col: str = "url") -> None:
    """Appends ``(hash_type, hash, url, inserted_at)`` to a Parquet store."""
    df.select(F.lit(hash_type).alias("hash_type"), F.col(hash_col).cast("string").alias("hash"), F.col(url_col).alias("url"), F.current_timestamp().alias("inserted_at")).write.mode("append").partitionBy("hash_type").parquet(path)


def original_url(store: DataFrame, hash_type: str, ttl_seconds: int = 0) -> DataFrame:
    """``(hash, url)`` of a store, the last writer winning, without rows past their time to live."""
    rows = store.where(F.col("hash_type") == hash_type)
    if ttl_seconds:
        rows = rows.where(F.col("inserted_at") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return rows.groupBy("hash").agg(F.max_by("url", "inserted_at").alias("url"))


def sign_hash(v: Column, planes: int = 16) -> Column:
    """Semantic hash of an embedding: a bit for the sign of each of ``planes`` signed sums of its parts."""

    def bit(k: int) -> Column:
        signed = F.transform(v, lambda x, i: F.when(F.pmod(F.hash(i, F.lit(k)), F.lit(2)) == 0, x).otherwise(-x).cast("double"))
        return F.when(F.aggregate(signed, F.lit(0.0).cast("double"), lambda a, x: a + x) > 0, 1 << k).otherwise(0)

    out = F.lit(0)
    for k in range(planes):
        out = out + bit(k)
    return out


def admit(urls: DataFrame, rules, url_col: str = "url", order_col: str = "seq", seen: DataFrame | None = None) -> DataFrame:
    """URL admission: adds ``normalized`` and ``outcome`` (``valid``, ``duplicate`` or ``invalid``).

    A URL is a duplicate if an earlier one with its normal form was valid, or if it is in ``seen``;
    an invalid one is invalid each time.
    """
    from ..functions import urls as U

    rows = once(urls, normalized=U.normalize(F.col(url_col)))
    rows = once(rows, _bad=F.col("normalized").isNull() | rules.reject_reason(F.col("normalized")).isNotNull())
    rows = first_wins(rows, F.when(~F.col("_bad"), F.col("normalized")), [order_col], "_first")  # the order is total
    if seen is not None:
        rows = rows.join(seen.select("normalized").distinct().withColumn("_seen", F.lit(True)), "normalized", "left")
    else:
        rows = rows.withColumn("_seen", F.lit(None).cast("boolean"))
    known = F.coalesce("_seen", F.lit(False))
    return rows.withColumn("outcome", F.when(known, "duplicate").when(F.col("_bad"), "invalid").when(F.col("_first"), "valid").otherwise("duplicate")).drop("_bad", "_first", "_seen")
