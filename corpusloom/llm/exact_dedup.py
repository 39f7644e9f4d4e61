"""Exact duplicates through an extendible-hash index on shared files.

The index has an entry for each distinct hash of a text: its bucket, its number of rows and the
largest doc_id.  The directory starts with one bucket and doubles while a bucket is overfull; entries
lie on shared files in the order of buckets and hashes.  A hash with one row needs no text.  The
distinct texts of every other hash go to the task that owns its key range, together with that range
of the index; there the texts under one hash form a chain and are told apart by their bytes.
DataFrame functions only.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import HOT_KEYS, free_name, staged

#: Entries a bucket holds before it is split, and the bits at which doubling stops (overfull buckets then lie over several ranges).
BUCKET_ENTRIES = 250_000
MAX_DEPTH = 20
#: Rows of a table that are sent to all tasks at most.
BROADCAST_KEYS = 1_000_000
#: Of keys with more rows the HOT_KEYS hottest are always sent to all tasks, so that no join gathers them.
HOT_ROWS = 100_000


def directory(cells: dict[int, int], capacity: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH) -> list[tuple[int, int]]:
    """Buckets as ``(local depth, prefix)``: overfull ones split and the directory doubles for them.

    ``cells`` counts the entries by the first ``max_depth`` bits of their hash.
    """
    below = [0] * ((1 << max_depth) + 1)
    for c, n in cells.items():
        below[c + 1] = n
    below = list(accumulate(below))
    done, open_ = [], [(0, 0)]
    while open_:
        depth, prefix = open_.pop()
        shift = max_depth - depth
        held = below[(prefix + 1) << shift] - below[prefix << shift]
        if held <= capacity or depth == max_depth:
            done.append((depth, prefix))
        else:
            open_ += [(depth + 1, 2 * prefix + 1), (depth + 1, 2 * prefix)]
    return sorted(done, key=lambda b: b[1] << (max_depth - b[0]))


def build_index(keyed: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """The index of ``keyed(doc_id, h)``: ``(bucket, h, entries, last_id)`` on shared files, by range of bucket and hash.

    A histogram reaches the driver: eight cells for each bucket's worth of entries, 2^MAX_DEPTH at most.
    """
    heads = staged(keyed.groupBy("h").agg(F.count("*").alias("entries"), F.max("doc_id").alias("last_id")), "heads")
    depth = min(MAX_DEPTH, max(3, (8 * heads.count() // max(1, capacity)).bit_length()))
    cell = F.shiftrightunsigned("h", 64 - depth)
    cells = {r[0]: r[1] for r in heads.groupBy(cell.alias("cell")).count().collect()}
    rows = []
    for number, (own, prefix) in enumerate(directory(cells, capacity, depth)):
        shift = depth - own
        rows += [(c, number) for c in range(prefix << shift, (prefix + 1) << shift)]
    lookup = keyed.sparkSession.createDataFrame(rows, "cell long, bucket int")
    placed = heads.withColumn("cell", cell).join(F.broadcast(lookup), "cell").select("bucket", "h", "entries", "last_id")
    return staged(placed.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"), "index")


def joined(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the unique ``keys``; the hottest keys, or all if they are few, are broadcast.

    ``how``: inner or left.  Either way gives the same rows.
    """
    if keys.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), on, how)
    hot = staged(keys.where(F.col(weight) > HOT_ROWS).orderBy(F.desc(weight), *on).limit(HOT_KEYS), "hot-keys")
    cold = rows.join(F.broadcast(hot), on, "left_anti").join(keys.join(F.broadcast(hot), on, "left_anti"), on, how)
    return cold.unionByName(rows.join(F.broadcast(hot), on))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; of equal texts the row with the largest doc_id stays.
    A null text counts as empty.  A null doc_id is smaller than any other; of several rows with the
    largest doc_id of a group all are marked as kept, as they can't be told apart.  Other columns
    are ignored; an empty table gives no rows.

    Only texts under hashes of several rows are moved, once for each distinct text and task, as copies
    are summed before the shuffle.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = src.select("doc_id", F.xxhash64("text").alias("h"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
    keyed = staged(hashed, "keys")
    index = build_index(keyed, capacity)
    chained = index.where("entries > 1")
    texts = src.select("doc_id", F.xxhash64("text").alias("h"), "text")
    texts = joined(texts, chained.select("bucket", "h", "entries"), ["h"], "entries")
    distinct = texts.groupBy("bucket", "h", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    # owner tasks: a range of the index with the texts of its hashes
    nothing = F.lit(None)
    ranges = chained.select("bucket", "h", "entries", nothing.cast("string").alias("text"), nothing.cast("long").alias("keep_id"), nothing.cast("long").alias("n"))
    ranges = ranges.unionByName(distinct.select("bucket", "h", nothing.cast("long").alias("entries"), "text", "keep_id", "n")).repartitionByRange("bucket", "h")
    chain = F.collect_list(F.when(F.col("n").isNotNull(), F.struct("text", "keep_id", "n"))).alias("chain")
    owned = ranges.groupBy("bucket", "h").agg(F.max("entries").alias("entries"), chain)
    links = owned.select("h", "entries", F.explode("chain").alias("c"))
    groups = links.select("h", F.sha2(F.encode("c.text", "UTF-8"), 256).alias("text_sha256"), "c.keep_id", F.col("c.n").alias("group_size"))
    groups = staged(groups, "groups")
    out = joined(keyed, groups, ["h", "text_sha256"], "group_size", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (alone | F.col("doc_id").eqNullSafe(keep)).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their dropped copies, with all their columns; a copy without a doc_id goes too."""
    sha = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    name, own = free_name(), free_name()
    gone = duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(own)).distinct()
    gone = staged(gone, "gone")
    few = gone.count() <= BROADCAST_KEYS // 4  # else both sides are shuffled
    return docs.join(F.broadcast(gone) if few else gone, F.col(name).eqNullSafe(docs[id_col]) & (F.col(own) == sha), "left_anti")
