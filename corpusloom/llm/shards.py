"""Shards of near equal bytes by a k-d tree over document metadata.

Points are groups of equal texts, weighted by their bytes, with the metadata of their first document
as coordinates: size on a log scale, place in the range of ids, and the share of all bytes that the
language and the source hold, each from 0 to 1.  A node is split across its widest dimension at the weighted median, found by a
distributed histogram that is refined until the median's cell is small, until each leaf holds its
share of the bytes.  Groups that are large against a shard are placed first, longest first, and the
tree fills up what they leave; a group over a shard's share is dealt out in parts.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import staged
from .exact_dedup import joined

#: Groups over this share of a shard are placed before the tree.
HEAVY = 1 / 16
CELLS = 4096
#: The median's cell holds this share of a shard at most, unless it is a single key.
TOLERANCE = 0.0005
_COORD = 1 << 30
_KEYS = ["h", "text_crc32", "size"]


def _place_heavy(items: list[tuple], shards: int) -> tuple[dict, list[float]]:
    """Longest first into the emptiest shard; returns shards by item and loads."""
    heap = [(0.0, s) for s in range(shards)]
    where, load = {}, [0.0] * shards
    for key, weight in sorted(items, key=lambda x: (-x[1], x[0])):
        got, s = heapq.heappop(heap)
        where[key], load[s] = s, got + weight
        heapq.heappush(heap, (load[s], s))
    return where, load


def _tree(points: DataFrame, dims: list[str], room: list[float]) -> list[tuple[int, int, str, int, int]]:
    """Splits ``(first leaf, end leaf, dimension, key, middle leaf)`` in order of depth.

    ``points(dims..., tie, weight)``; keys are ``coordinate << 32 | tie``.
    """
    splits: list[tuple[int, int, str, int, int]] = []
    level = [(0, len(room))]
    while level := [(a, b) for a, b in level if b - a > 1]:
        node = _leaf(splits)
        tagged = points.withColumn("node", node)
        spans = [F.min(d).alias(f"{d}_lo") for d in dims] + [F.max(d).alias(f"{d}_hi") for d in dims]
        found = {r["node"]: r for r in tagged.groupBy("node").agg(F.sum("weight").alias("w"), *spans).collect()}  # a row a node
        open_: dict[int, list] = {}
        done: list[tuple[int, int, str, int, int]] = []
        for a, b in level:
            mid, r = (a + b) // 2, found.get(a)
            total = sum(room[a:b])
            if r is None:
                done.append((a, b, dims[0], 0, mid))
                continue
            dim = max(dims, key=lambda d: (r[f"{d}_hi"] - r[f"{d}_lo"], d))
            target = r["w"] * (sum(room[a:mid]) / total if total > 0 else 0.5)
            open_[a] = [b, mid, dim, r[f"{dim}_lo"] << 32, (r[f"{dim}_hi"] + 1) << 32, 0.0, target]
        while open_:
            cell = F.lit(None).cast("long")
            for a, (_, _, dim, lo, hi, _, _) in open_.items():
                key = F.shiftleft(F.col(dim), 32).bitwiseOR(F.col("tie"))
                width = max(1, -(-(hi - lo) // CELLS))
                cell = F.when((F.col("node") == a) & (key >= lo) & (key < hi), ((key - F.lit(lo)) / F.lit(width)).cast("long") if width == 1 else F.expr(f"(({dim} << 32 | tie) - {lo}L) div {width}L")).otherwise(cell)
            sums = tagged.withColumn("cell", cell).where("cell is not null").groupBy("node", "cell").agg(F.sum("weight").alias("w"))
            by: dict[int, list] = {}
            for r in sums.collect():  # CELLS rows a node at most
                by.setdefault(r["node"], []).append((r["cell"], r["w"]))
            for a in list(open_):
                b, mid, dim, lo, hi, below, target = open_[a]
                width = max(1, -(-(hi - lo) // CELLS))
                cells = sorted(by.get(a, []))
                at, held = None, below
                for c, w in cells:
                    if held + w >= target or (c, w) == cells[-1]:
                        at = (c, w)
                        break
                    held += w
                if at is None:
                    done.append((a, b, dim, lo, mid))
                    del open_[a]
                elif width == 1 or at[1] <= TOLERANCE * max(room):
                    first = lo + at[0] * width
                    cut = first if target - held <= held + at[1] - target else first + width
                    done.append((a, b, dim, cut, mid))
                    del open_[a]
                else:
                    open_[a] = [b, mid, dim, lo + at[0] * width, min(hi, lo + (at[0] + 1) * width), held, target]
        splits += done
        level = [x for a, b in level for x in ((a, (a + b) // 2), ((a + b) // 2, b))]
    return splits


def _leaf(splits: list[tuple[int, int, str, int, int]]):
    """The first leaf of each point's node after these splits."""
    node = F.lit(0)
    by_depth: dict[int, list] = {}
    for s in splits:
        by_depth.setdefault(s[1] - s[0], []).append(s)
    for size in sorted(by_depth, reverse=True):
        moved = node
        for a, _, dim, cut, mid in by_depth[size]:
            key = F.shiftleft(F.col(dim), 32).bitwiseOR(F.col("tie"))
            moved = F.when((node == a) & (key >= cut), F.lit(mid)).otherwise(moved)
        node = moved
    return node


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the law is ``bytes``.

    ``size``: UTF-8 bytes of the text (null: none) plus one.  ``slot`` counts a shard's rows without
    gaps from 0.  Equal texts share a shard unless they fill one on their own.  Null metadata counts
    as smallest; repeated rows are rows of their own; further columns are ignored; an empty table
    gives no rows.  ``shards`` is a power of two.
    """
    if shards & (shards - 1) or shards < 1:
        raise ValueError("shards must be a power of two")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = {c.lower() for c in docs.columns}
    pick = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in cols else F.lit("")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"), pick("lang").alias("lang"), pick("source").alias("source"),
    )
    rows = staged(rows, "rows")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("d"), "lang", "source"))
    groups = staged(rows.groupBy(*_KEYS).agg(F.sum("size").alias("weight"), first.alias("first")), "groups")
    total, low, high = groups.agg(F.sum("weight"), F.min("first.d"), F.max("first.d")).head()
    total = total or 0
    share = total / shards

    # groups over HEAVY of a share: at most shards / HEAVY of them
    heavy = groups.where(F.col("weight") > HEAVY * share).select(*_KEYS, "weight").collect() if total else []
    parts, names = [], {}
    for i, r in enumerate(heavy):
        n = 1 if r["weight"] <= share else -(-int(r["weight"]) // max(1, int(HEAVY * share)))
        names[i] = n
        parts.append((r["h"], r["text_crc32"], r["size"], i, n))
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(parts, "h long, text_crc32 long, size long, grp int, n_parts int"))
    marked = rows.join(table, _KEYS, "left").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("n_parts")))
    weights = marked.where("grp is not null").groupBy("grp", "part").agg(F.sum("size").alias("w")).collect() if parts else []
    where, load = _place_heavy([((r["grp"], r["part"]), r["w"]) for r in weights], shards)
    rest = total - sum(load)
    even = max(share, max(load, default=0))
    room = [max(0.0, even - x) for x in load]
    scale = rest / sum(room) if sum(room) else 0.0
    room = [x * scale for x in room]

    span = max(1, (high or 0) - (low or 0))
    light = groups.where(F.col("weight") <= HEAVY * share) if total else groups
    for c in ("lang", "source"):  # a category lies at its share of the bytes: from rare ones to common ones
        own = light.groupBy(F.col(f"first.{c}").alias(c)).agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
        at = (F.col("w") / F.lit(max(1, total)) * (_COORD - 1)).cast("long")
        own = staged(own.select(c, at.alias(f"by_{c}"), "n"), "categories")
        light = joined(light.withColumn(c, F.col(f"first.{c}")), own, [c], "n").drop("n", c)
    dims = {
        "by_size": F.least(F.lit(_COORD - 1), (F.log2(F.col("size")) * (_COORD / 40)).cast("long")),
        "by_id": F.least(F.lit(_COORD - 1), ((F.col("first.d") - F.lit(low or 0)) / F.lit(span) * (_COORD - 1)).cast("long")),
        "by_lang": F.col("by_lang"), "by_source": F.col("by_source"),
    }
    points = light.select(*_KEYS, "weight", F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tie"), *[v.cast("long").alias(k) for k, v in dims.items()])
    points = staged(points, "points")
    leaf = _leaf(_tree(points, list(dims), room)) if shards > 1 else F.lit(0)
    leaves = points.select(*_KEYS, leaf.alias("shard"))
    out = ["rid", "doc_id", "size", "text_crc32", "shard"]
    placed = marked.where("grp is null").drop("grp", "n_parts", "part").join(leaves, _KEYS).select(*out)
    if where:
        spots = F.broadcast(spark.createDataFrame([(g, p, s) for (g, p), s in where.items()], "grp int, part long, shard int"))
        placed = placed.unionByName(marked.where("grp is not null").join(spots, ["grp", "part"]).select(*out))
    return _slots(staged(placed, "placed"), shards)


def _slots(placed: DataFrame, shards: int) -> DataFrame:
    """Slots by counting in strips of each shard, so that no task holds a shard."""
    n = placed.count()
    strips = max(64, n // (shards * 200_000))
    strip = F.pmod(F.xxhash64("doc_id", "rid"), F.lit(strips)).alias("strip")
    rows = placed.select("*", strip)
    sums = rows.groupBy("shard", "strip").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("strip").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("shard", "strip", before.alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "strip").orderBy("doc_id", "rid")) - 1
    rows = rows.withColumn("number", number).join(sums, ["shard", "strip"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
