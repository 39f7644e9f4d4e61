"""Packing of token pieces into fixed-size sequences by best fit and swap-based local search.

Pieces that fill a sequence take one each.  The others are dealt evenly into independent groups of a
bounded size; in a group, best fit (longest first) is followed by a local search over the bins that
are not full: exchanges of one piece for one, two pieces for one, and moves, each taken if it raises
the sum of squared fills, so that some bins fill up and others empty, until no step helps.  The bins
that are not full then are packed again over all groups.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged
from .bpe import added_tokens, encoder, packed_with_added, small_lists

#: Pieces to a group.
GROUP = 20_000


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: one unless it is longer than ``size``; then all are
    ``size`` long but for the first, which holds the remainder."""
    first = n % size or size
    return [(0, n)] if n <= size else [(0, first), *[(s, size) for s in range(first, n, size)]]


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: longest items first, each into the fullest bin with room."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in order:
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if left > lengths[i]:
            insort(room, (left - lengths[i], b))
    return bins


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Exchanges between underfull bins that raise the sum of squared fills; empty bins go.

    Emptiest bins give first: a piece moves to the bin with the least room that takes it, or one or two
    pieces go for a shorter one of the bin that this leaves with the least room.  All bins with room
    give and all are looked up, by the total that would fill them; passes go on until no step helps.
    Each step raises the sum of squares, so it ends.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    open_ = [b for b in range(len(bins)) if 0 < fill[b] < size]
    room = sorted((size - fill[b], b) for b in open_)
    # a total of key fills the bin if it gives up piece i
    swaps = sorted((lengths[i] + size - fill[b], lengths[i], b, i) for b in open_ for i in bins[b])

    def forget(b: int) -> None:
        room.pop(bisect_left(room, (size - fill[b], b)))
        for i in bins[b]:
            swaps.pop(bisect_left(swaps, (lengths[i] + size - fill[b], lengths[i], b, i)))

    def note(b: int) -> None:
        fill[b] = sum(lengths[i] for i in bins[b])
        if 0 < fill[b] < size:
            insort(room, (size - fill[b], b))
            for i in bins[b]:
                insort(swaps, (lengths[i] + size - fill[b], lengths[i], b, i))

    def step(a: int, b: int, given: tuple, got: tuple) -> None:
        forget(a)
        forget(b)
        bins[a] = [i for i in bins[a] if i not in given] + list(got)
        bins[b] = [i for i in bins[b] if i not in got] + list(given)
        note(a)
        note(b)

    def move(a: int) -> bool:
        for i in sorted(bins[a], key=lambda i: (-lengths[i], i)):
            at = bisect_left(room, (lengths[i], -1))
            if at < len(room) and room[at][1] == a:
                at += 1
            if at < len(room) and fill[room[at][1]] + lengths[i] > fill[a]:
                step(a, room[at][1], (i,), ())
                return True
        return False

    def exchange(a: int) -> bool:
        own = bins[a]
        give = {lengths[i] + lengths[j]: (i, j) for k, i in enumerate(own) for j in own[k + 1 :]}
        give.update({lengths[i]: (i,) for i in own})
        best, most = None, size - fill[a]  # the partner ends up fuller than a was, so with less room
        for total, given in give.items():
            for at in range(bisect_left(swaps, (total,)), len(swaps)):
                key, length, b, i = swaps[at]
                if key - total >= most:
                    break
                if b != a and total - length > max(0, fill[a] - fill[b]):
                    best, most = (b, given, i), key - total
                    break
            if most == 0:
                break
        if best:
            step(a, best[0], best[1], (best[2],))
        return best is not None

    changed = True
    while changed:
        changed = False
        for a in sorted((b for b in range(len(bins)) if 0 < fill[b] < size), key=lambda b: (fill[b], b)):
            while 0 < fill[a] < size and (move(a) or exchange(a)):
                changed = True
    return [b for b in bins if b]


def pack(lengths: list[int], size: int) -> list[list[int]]:
    return local_search(best_fit(lengths, size), lengths, size)


def pieces(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, keep_ids: bool = False, fast: bool = True) -> DataFrame:
    """Tokens of every document, cut: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document's tokens are its ids and then ``end_id``, so a null or empty text is one token long.
    Added tokens of the tokenizers file are one id each wherever a text holds them.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        enc, added = encoder(path, fast), added_tokens(path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, at = b.column(0).to_pylist(), 0
            for texts in small_lists(b.column(1).to_pylist()):
                out: list[list] = [[] for _ in range(5 + keep_ids)]
                for doc, packed in zip(ids[at : at + len(texts)], packed_with_added(enc, texts, added)):
                    packed += end
                    for k, (start, n) in enumerate(cut(len(packed) // 4, size)):
                        part = packed[4 * start : 4 * (start + n)]
                        row = (doc, k, start, n, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int32),) if keep_ids else ())
                        for c, v in zip(out, row):
                            c.append(v)
                at += len(texts)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [c.split()[0] for c in kind.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, kind)


def place(rows: DataFrame, size: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of at most ``size``.

    Rows are dealt into groups by a hash of all their columns and a row number, so that copies
    spread; full rows are sequences of their own.  A second pass takes the bins with room from all
    groups together, as items of their own.
    """
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in rows.columns if c != "_row"]
    whole = rows.where(F.col("length") >= size).select(*columns, (F.col("_row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = rows.where(F.col("length") < size)
    n = part.count()
    first = _packed(part.select("_row", "length"), size, max(1, -(-n // group)), "_row", "length")
    first = staged(first, "packed")
    open_ = first.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < size)
    open_ = staged(open_, "open")
    names = first.join(_renamed(open_, size, group), "bin", "left")
    placed = names.select("_row", F.coalesce("to", "bin").alias("sequence_id"), (F.coalesce("shift", F.lit(0)) + F.col("offset")).cast("long").alias("offset"))
    return whole.unionByName(part.join(placed, "_row").select(*columns, (F.col("sequence_id") * 2 + 1).alias("sequence_id"), "offset"))


def _renamed(open_: DataFrame, size: int, group: int) -> DataFrame:
    """``(bin, to, shift)``: bins with room, packed over all groups as items."""
    n = open_.count()
    again = _packed(open_, size, max(1, -(-n // group)), "bin", "fill")
    return again.select(F.col("bin_").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("shift"))


def _packed(items: DataFrame, size: int, groups: int, key: str, length: str) -> DataFrame:
    """``(key, length, bin, offset)``: items packed within groups; a bin is named by its first key."""
    name = key if key != "bin" else "bin_"

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:  # a task gets whole groups of a bounded size
            for g, k, n in zip(*[b.column(i).to_pylist() for i in range(3)]):
                held.setdefault(g, []).append((k, n))
        for got in held.values():
            got.sort()
            lengths = [n for _, n in got]
            out: tuple[list, list, list, list] = ([], [], [], [])
            for members in pack(lengths, size):
                at = 0
                for i in members:
                    for c, v in zip(out, (got[i][0], lengths[i], got[members[0]][0], at)):
                        c.append(v)
                    at += lengths[i]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [name, "length", "bin", "offset"])

    dealt = items.select(F.pmod(F.xxhash64(F.col(key)), F.lit(groups)).alias("g"), F.col(key).alias("k"), F.col(length).alias("n"))
    return dealt.repartition(groups, "g").mapInArrow(run, f"{name} long, length long, bin long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts count as empty (one end token).  Repeated rows are packed as often as they come; ties
    in length go by row; further columns are ignored; an empty table gives no rows.
    """
    return place(pieces(docs, path, size, id_col, text_col), size, group)


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` from placed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
