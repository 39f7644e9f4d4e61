"""SimHash near-duplicate groups by a generalised pigeonhole search.

Fingerprints within ``tau`` bits are linked.  The 64 bits are arranged in ``m`` partitions, with
correlated bits together; for each fingerprint a dynamic programme spreads ``tau - m + 1`` over the
partitions as thresholds (``-1`` skips one) at the least estimated number of candidates.  For any
pair within ``tau`` bits, some partition then differs by no more than its threshold, so probing all
partition values within the thresholds and verifying what they meet finds every link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, free_name, staged

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Buckets with more rows are dealt out again on further bits.
HOT_BUCKET = 4096
#: Ids of dropped rows that are sent to all tasks at most.
BROADCAST_IDS = 1_000_000
#: Within a task, buckets up to this size are compared by shifted columns, larger ones by search.
SMALL_BUCKET = 24


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the ``width``-word shingles; 0 for null or blank texts."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    buf = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    starts, ends = (end - size)[: 1 - width].tolist(), end[width - 1 :].tolist()
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65536):
        pairs = zip(starts[at : at + 65536], ends[at : at + 65536])
        h = np.array([digest(buf[i:j], 42) for i, j in pairs], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row, ``fp`` as a signed long.  Null and blank texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


class Plan:
    """Bit partitions and distance histograms, from which thresholds are allocated."""

    def __init__(self, order: list[list[int]], tau: int, n: int):
        self.order, self.tau, self.n, self.m = order, tau, n, len(order)
        #: Slices of at most 11 bits, whose exact value counts give the estimates.
        self.slices = [[p[i : i + 11] for i in range(0, len(p), 11)] for p in order]
        self.near: list[list[np.ndarray]] = []

    @staticmethod
    def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
        """The named bits of each fingerprint as one number, the first bit lowest."""
        out = np.zeros(len(fp), np.uint64)
        for k, b in enumerate(bits):
            out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
        return out

    def learn(self, counts: dict[tuple[int, int], np.ndarray]) -> None:
        """``counts``: histogram of each slice.  Keeps, for each value, the share at distance 0..tau."""
        for i, group in enumerate(self.slices):
            self.near.append([])
            for j, bits in enumerate(group):
                size = 1 << len(bits)
                pop = np.bitwise_count(np.arange(size, dtype=np.uint32))
                table, h = np.zeros((size, self.tau + 1)), counts[(i, j)].astype(float)
                at = np.arange(size)
                for mask in np.flatnonzero(pop <= self.tau):
                    table[:, pop[mask]] += h[at ^ mask]
                self.near[i].append(table / max(1, self.n))

    def estimates(self, fp: np.ndarray, i: int) -> np.ndarray:
        """Estimated candidates of partition ``i`` for thresholds 0..tau, slices taken as independent."""
        share = None
        for bits, table in zip(self.slices[i], self.near[i]):
            t = table[self.gather(fp, bits).astype(np.int64)]
            if share is None:
                share = t
            else:
                share = np.stack([sum(share[:, a] * t[:, d - a] for a in range(d + 1)) for d in range(self.tau + 1)], axis=1)
        return np.cumsum(share, axis=1) * self.n

    def allocate(self, fp: np.ndarray) -> np.ndarray:
        """Thresholds by dynamic programming: one row per fingerprint, summing to ``tau - m + 1``."""
        total, low = self.tau - self.m + 1, -1
        span = total + self.m  # sums are kept from -m; each threshold lies in -1..total + m - 1
        best = np.full((len(fp), span + 1), np.inf)
        best[:, 0] = 0
        choice = []
        for i in range(self.m):
            est, width = self.estimates(fp, i), len(self.order[i])
            new = np.full_like(best, np.inf)
            pick = np.zeros(best.shape, np.int8)
            for t in range(low, min(self.tau, total + self.m - 1) + 1):
                probes = sum(len(list(combinations(range(width), d))) for d in range(1, t + 1)) if t < 3 else width**3
                cost = 0 if t < 0 else est[:, t] + probes
                for s in range(span - t):
                    via = best[:, s] + cost
                    better = via < new[:, s + t + 1]
                    new[better, s + t + 1] = via[better]
                    pick[better, s + t + 1] = t
            best = new
            choice.append(pick)
        out, s = np.zeros((len(fp), self.m), np.int64), np.full(len(fp), span)
        for i in range(self.m - 1, -1, -1):
            out[:, i] = choice[i][np.arange(len(fp)), s]
            s = s - out[:, i] - 1
        return out

    def probes(self, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(key, fp, rep)`` rows: every partition value, and its variants within the threshold."""
        t = self.allocate(fp)
        keys, fps, reps = [], [], []
        for i, bits in enumerate(self.order):
            value = self.gather(fp, bits)
            for d in range(0, int(t[:, i].max(initial=0)) + 1):
                who = np.flatnonzero(t[:, i] >= d) if d else np.arange(len(fp))
                for flip in combinations(range(len(bits)), d):
                    mask = np.uint64(sum(1 << k for k in flip))
                    keys.append(((value[who] ^ mask) << np.uint64(3)) | np.uint64(i))
                    fps.append(fp[who])
                    reps.append(rep[who])
        return np.concatenate(keys), np.concatenate(fps), np.concatenate(reps)


def correlated(cov: np.ndarray, m: int) -> list[list[int]]:
    """Greedy partitions of the 64 bits: each takes the free bits most correlated with its own."""
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        left = sorted(free)
        part = [max(left, key=lambda b: (corr[b, left].max(), -b))]
        free.discard(part[0])
        while len(part) < size:
            b = max(sorted(free), key=lambda x: (corr[x, part].sum(), -x))
            part.append(b)
            free.discard(b)
        out.append(sorted(part))
    return out


def make_plan(fps: DataFrame, tau: int) -> Plan:
    """Statistics over all distinct fingerprints: 64 x 64 bit counts, then slice histograms."""

    def pairs(batches):
        both = np.zeros((64, 64), np.int64)
        n = 0
        for b in batches:
            bits = np.unpackbits(np.ascontiguousarray(b.column(0).to_numpy()).view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        at = np.arange(64 * 64 + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(both.ravel(), n))], ["k", "n"])

    got = np.zeros(64 * 64 + 1)
    for k, n in fps.select("fp").mapInArrow(pairs, "k long, n long").groupBy("k").agg(F.sum("n")).collect():  # 4097 rows
        got[k] = n
    n = int(got[-1])
    p = got[:-1].reshape(64, 64) / max(1, n)
    m = min((2, 3, 4), key=lambda m: _uniform_cost(m, n, tau)) if tau == 3 else max(1, min(8, tau + 1))
    plan = Plan(correlated(p - np.outer(np.diag(p), np.diag(p)), m), tau, n)

    def values(batches):
        hist = {(i, j): np.zeros(1 << len(bits), np.int64) for i, g in enumerate(plan.slices) for j, bits in enumerate(g)}
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for (i, j), h in hist.items():
                h += np.bincount(plan.gather(fp, plan.slices[i][j]).astype(np.int64), minlength=len(h))
        for (i, j), h in hist.items():
            v = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i * 100 + j)), pa.array(v), pa.array(h[v])], ["s", "v", "n"])

    counts = {(i, j): np.zeros(1 << len(bits), np.int64) for i, g in enumerate(plan.slices) for j, bits in enumerate(g)}
    table = fps.select("fp").mapInArrow(values, "s long, v long, n long").groupBy("s", "v").agg(F.sum("n"))
    for s, v, k in table.collect():  # a row per slice value: at most 8 x 2048 rows
        counts[(s // 100, s % 100)][v] = k
    plan.learn(counts)
    return plan


def _uniform_cost(m: int, n: int, tau: int) -> float:
    """Probes and candidates of a fingerprint among ``n`` evenly spread ones, thresholds spread evenly."""
    total, width, cost = tau - m + 1, 64 // m, 0.0
    for i in range(m):
        t = total // m + (i < total % m)
        probes = sum(len(list(combinations(range(width), d))) for d in range(t + 1))
        cost += probes * (1 + n / 2.0**width)
    return cost


def _links(batches):
    """Spanning links of each bucket; rows come sorted by key.  Memory holds one batch and one bucket."""
    rest: list[list[np.ndarray]] = []  # parts of the last bucket so far
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = int(np.argmax(same))
        if rest and (cut or rest[0][0][0] != cols[0][0] or rest[0][1][0] != cols[1][0]):
            yield from _within([np.concatenate(c) for c in zip(*rest, [c[:cut] for c in cols])])
            rest = []
        elif cut:
            yield from _within([c[:cut] for c in cols])
        rest.append([c[cut:] for c in cols])
    if rest:
        yield from _within([np.concatenate(c) for c in zip(*rest)])


def _within(cols):
    key, sub, fp, rep = cols
    if not len(key):
        return
    fp = fp.view(np.uint64)
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
    size = np.diff(np.r_[start, len(key)])
    out_a, out_b = [], []
    bucket = np.repeat(np.arange(len(start)), size)
    small = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL_BUCKET), size))
    d = 1
    while len(small):
        small = small[small + d < len(key)]
        small = small[bucket[small] == bucket[small + d]]
        hit = small[np.bitwise_count(fp[small] ^ fp[small + d]) <= 3]
        out_a.append(rep[hit])
        out_b.append(rep[hit + d])
        d += 1
    for s, n in zip(start[size > SMALL_BUCKET], size[size > SMALL_BUCKET]):
        f, uniq = np.unique(fp[s : s + n], return_index=True)
        r, left = rep[s : s + n][uniq], np.arange(len(uniq))
        queue: list[int] = []
        while len(left):
            if queue:
                u = queue.pop()
            else:
                u, left = int(left[0]), left[1:]
            near = np.bitwise_count(f[left] ^ f[u]) <= 3
            if near.any():
                found = left[near]
                out_a.append(np.full(len(found), r[u]))
                out_b.append(r[found])
                queue.extend(found.tolist())
                left = left[~near]
    if out_a:
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        keep = a != b
        if keep.any():
            ab = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[keep], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])


def links(fps: DataFrame, tau: int = 3) -> DataFrame:
    """Links ``(a, b)`` that connect what lies within ``tau`` bits, from distinct ``(fp, rep)`` rows.

    All pairs of a bucket are never emitted: a bucket gives a spanning forest of its links, which
    leaves the components as they are.  Buckets over ``HOT_BUCKET`` rows are dealt out again twice
    by further quarters of the bits, one of which must be equal for any pair within three bits.
    """
    if tau > 3:
        raise ValueError("quarters of the bits find links of at most three bits")
    plan = make_plan(fps, tau)

    def probe(batches):
        for b in batches:
            for at in range(0, b.num_rows, 20000):
                part = b.slice(at, 20000)
                k, f, r = plan.probes(part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.zeros(len(k), np.int64)), pa.array(f.view(np.int64)), pa.array(r)], ["key", "sub", "fp", "rep"])

    rows = staged(fps.select("fp", "rep").mapInArrow(probe, "key long, sub long, fp long, rep long"), "probes")
    done = []
    for level in range(2):
        full = rows.groupBy("key", "sub").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BUCKET)
        full = staged(full, "hot")
        if full.isEmpty():
            break
        hot = full.select("key", "sub", F.lit(True).alias("hot"))
        marked = rows.join(hot, ["key", "sub"], "left")
        done.append(marked.where("hot is null").drop("hot"))
        quarters = [[b for b in range(64) if (b % 4 if level == 0 else b // 16) == q] for q in range(4)]

        def deal(batches, quarters=quarters, level=level):
            for b in batches:
                fp = b.column(2).to_numpy().view(np.uint64)
                for q, bits in enumerate(quarters):
                    sub = (b.column(1).to_numpy() << 18) | (Plan.gather(fp, bits).astype(np.int64) << 2) | q
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sub), b.column(2), b.column(3)], ["key", "sub", "fp", "rep"])

        rows = marked.where("hot").drop("hot").mapInArrow(deal, "key long, sub long, fp long, rep long")
        rows = staged(rows, "probes")
    for part in done:
        rows = rows.unionByName(part)
    return rows.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_links, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 3, width: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``tau`` bits.  Copies
    share a fingerprint and are one point of the search.  Null or blank texts have fingerprint zero
    and are linked like any other; repeated rows come back as often as they came in, and rows that
    share a doc_id are one point of the graph; rows without a doc_id keep their fingerprint, link
    nothing and have a null component; an empty table gives none.  Further columns are ignored.
    """
    fp = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    reps = staged(fp.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps").where("rep is not null")
    same = fp.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("f"), F.max("fp").alias("g")).where("f != g")
    twice = fp.join(same.select("doc_id"), "doc_id").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links(reps, tau).union(twice))
    named = reps.join(roots, reps.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = fp.join(named, "fp", "left")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return out.select("doc_id", hexed, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 3, width: int = 3) -> DataFrame:
    """The documents, with all their columns, but of each component only that with the smallest doc_id.

    Repeated rows of one doc_id stay together, as do rows without a doc_id.
    """
    groups = near_groups(docs, id_col, text_col, tau, width)
    name = free_name()
    gone = staged(groups.where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS  # else both sides are shuffled
    return docs.join(F.broadcast(gone) if few else gone, F.col(name) == docs[id_col], "left_anti")
