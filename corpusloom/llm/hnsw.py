"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Equal vectors are one node.  Nodes are dealt evenly into shards of a bounded size; each shard's
graph is built in batches, with all steps of a batch done together, and stored as flat neighbour
arrays in the shared folder.  Queries are sent to all shards in blocks, and the shards' results are
merged by exact cosines of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import staged

#: Nodes to a shard and queries to a block: what a task holds.
SHARD, BLOCK = 4096, 8192
#: Links of a node above the ground layer (twice as many there), and beams of building and searching.
LINKS, BUILD_BEAM, BEAM = 16, 64, 96
BATCH = 256


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes found for each query, best first, by ``(numbers, similarities)``; -1 pads.

    All queries advance together: each step expands the best node not yet expanded of every beam.
    """
    rows, n = len(q), len(x)
    seen = np.zeros((rows, n + 1), bool)
    seen[:, n] = True
    best = np.full((rows, beam), -1)
    sim = np.full((rows, beam), -np.inf, np.float32)
    k = min(beam, entry.shape[1])
    e = entry[:, :k]
    s = np.where(e >= 0, np.einsum("qkd,qd->qk", x[e], q), -np.inf)
    o = np.argsort(-s, axis=1, kind="stable")
    best[:, :k], sim[:, :k] = np.take_along_axis(e, o, 1), np.take_along_axis(s, o, 1)
    np.put_along_axis(seen, np.where(e >= 0, e, n), True, 1)
    done = best < 0
    live = np.arange(rows)
    while len(live):
        at = np.argmin(done[live], axis=1)
        go = ~done[live, at]
        live, at = live[go], at[go]
        if not len(live):
            break
        done[live, at] = True
        near = links[best[live, at]]
        fresh = np.where(near >= 0, near, n)
        new = ~seen[live[:, None], fresh]
        seen[live[:, None], fresh] = True
        s = np.where(new, np.einsum("qkd,qd->qk", x[np.where(near >= 0, near, 0)], q[live]), -np.inf).astype(np.float32)
        all_sim = np.concatenate([sim[live], s], axis=1)
        all_id = np.concatenate([best[live], np.where(new, near, -1)], axis=1)
        all_done = np.concatenate([done[live], ~new], axis=1)
        o = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
        best[live], sim[live] = np.take_along_axis(all_id, o, 1), np.take_along_axis(all_sim, o, 1)
        done[live] = np.take_along_axis(all_done, o, 1)
        done[live] |= best[live] < 0
    return best, sim


def diverse(x: np.ndarray, own: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """For each node of ``own``, up to ``most`` of its candidates: nearest first, skipping those nearer
    to one already taken than to the node; free places go to the nearest skipped ones."""
    ok = (cand >= 0) & (cand != own[:, None])
    s = np.where(ok, np.einsum("tcd,td->tc", x[np.where(ok, cand, 0)], x[own]), -np.inf)
    o = np.argsort(-s, axis=1, kind="stable")
    cand, s = np.take_along_axis(np.where(ok, cand, -1), o, 1), np.take_along_axis(s, o, 1)
    v = x[np.where(cand >= 0, cand, 0)]
    pair = v @ v.transpose(0, 2, 1)
    taken = np.zeros(cand.shape, bool)
    count = np.zeros(len(own), int)
    for j in range(cand.shape[1]):
        good = (cand[:, j] >= 0) & (count < most) & ~((pair[:, j, :] > s[:, j : j + 1]) & taken).any(axis=1)
        same = ((cand == cand[:, j : j + 1]) & taken).any(axis=1)
        good &= ~same
        taken[:, j] = good
        count += good
    for j in range(cand.shape[1]):
        fill = (cand[:, j] >= 0) & ~taken[:, j] & (count < most)
        fill &= ~((cand == cand[:, j : j + 1]) & taken).any(axis=1)
        taken[:, j] |= fill
        count += fill
    o = np.argsort(~taken, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(taken, o, 1), np.take_along_axis(cand, o, 1), -1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


class Graph:
    """Layers from the ground up, each a matrix of neighbours by node (-1 pads)."""

    def __init__(self, x: np.ndarray, level: np.ndarray, layers: list[np.ndarray] | None = None):
        self.x, self.level = np.ascontiguousarray(x, np.float32), level
        self.layers: list[np.ndarray] = layers or []
        if layers is None:
            self._build()

    @property
    def top(self) -> np.ndarray:
        return np.flatnonzero(self.level == self.level.max())[:32]

    def _entries(self, q: np.ndarray, above: list[np.ndarray], beam: int = 8) -> np.ndarray:
        """Start nodes for a layer: what a search through the layers above it ends with."""
        entry = np.broadcast_to(self.top, (len(q), len(self.top)))
        for links in above:
            entry = beam_search(self.x, links, q, entry, beam)[0]
        return entry

    def _build(self) -> None:
        n, built = len(self.x), []  # top layer first
        for layer in range(int(self.level.max()), -1, -1):
            nodes = np.flatnonzero(self.level >= layer)
            most = LINKS * (2 if layer == 0 else 1)
            links = np.full((n, most), -1)
            start = nodes[np.argsort(-self.level[nodes], kind="stable")]  # what upper layers hold comes first
            for s in range(0, len(start), BATCH):
                part = start[s : s + BATCH]
                q = self.x[part]
                inner = q @ q.T
                np.fill_diagonal(inner, -np.inf)
                k = min(len(part) - 1, BUILD_BEAM // 2)
                cand = part[np.argsort(-inner, axis=1, kind="stable")[:, :k]] if k > 0 else np.zeros((len(part), 0), int)
                if s:
                    found = beam_search(self.x, links, q, self._start(q, built, start[:s]), BUILD_BEAM)[0]
                    cand = np.concatenate([found, cand], axis=1)
                if not cand.shape[1]:
                    continue
                links[part] = np.pad(diverse(self.x, part, cand, LINKS), ((0, 0), (0, most - LINKS)), constant_values=-1)
                self._back(links, part, most)
            built.append(links)
        self.layers = built[::-1]

    def _start(self, q: np.ndarray, above: list[np.ndarray], inserted: np.ndarray) -> np.ndarray:
        if not above:
            return np.broadcast_to(inserted[:32], (len(q), min(32, len(inserted))))
        return self._entries(q, above)

    def _back(self, links: np.ndarray, part: np.ndarray, most: int) -> None:
        """Adds the links back from what the new nodes point to; full lists are chosen anew."""
        to, of = links[part].ravel(), np.repeat(part, links.shape[1])
        of, to = of[to >= 0], to[to >= 0]
        o = np.argsort(to, kind="stable")
        to, of = to[o], of[o]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        size = np.diff(np.r_[first, len(to)])
        goal = to[first]
        for at in range(0, len(goal), 1024):
            g, f, m = goal[at : at + 1024], first[at : at + 1024], size[at : at + 1024]
            more = np.full((len(g), int(m.max())), -1)
            for j in range(more.shape[1]):
                has = m > j
                more[has, j] = of[f[has] + j]
            cand = np.concatenate([links[g], more], axis=1)
            width = (cand >= 0).sum(axis=1).max()
            o = np.argsort(cand < 0, axis=1, kind="stable")[:, :width]
            links[g] = diverse(self.x, g, np.take_along_axis(cand, o, 1), most)

    def search(self, q: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
        """Numbers of the ``k`` nearest nodes found for each query, nearest first; -1 pads."""
        out = []
        for at in range(0, len(q), BATCH):
            part = np.ascontiguousarray(q[at : at + BATCH], np.float32)
            out.append(beam_search(self.x, self.layers[0], part, self._entries(part, self.layers[:0:-1]), max(beam, k))[0][:, :k])
        return np.concatenate(out) if out else np.zeros((0, k), int)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def build(nodes: DataFrame) -> DataFrame:
    """Graphs of ``nodes(dim, shard, ids, v)``, one row a node: its number, level and flat links by layer."""
    kind = "dim int, shard int, node int, ids array<long>, v array<double>, level int, links array<int>"

    def run(pdf):
        pdf = pdf.assign(first=[min(i) for i in pdf["ids"]]).sort_values("first", ignore_index=True)
        u = np.array([((int(i) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (2**64 - 1)) ** 2 % (2**61 - 1) for i in pdf["first"]], float) / 2.0**61
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(int), 6)
        g = Graph(_unit(np.stack(pdf["v"].to_numpy())), level)
        flat = [np.concatenate([g.layers[k][i] for k in range(level[i] + 1)]).astype(np.int32) for i in range(len(pdf))]
        return pd.DataFrame({"dim": pdf["dim"], "shard": pdf["shard"], "node": np.arange(len(pdf), dtype=np.int32), "ids": pdf["ids"], "v": pdf["v"], "level": level.astype(np.int32), "links": flat})

    return nodes.groupBy("dim", "shard").applyInPandas(run, kind)


def load(pdf: pd.DataFrame) -> Graph:
    """A shard's graph from its rows, sorted by node."""
    x, level = _unit(np.stack(pdf["v"].to_numpy())), pdf["level"].to_numpy()
    layers = []
    for k in range(int(level.max()) + 1):
        most, skip = (2 * LINKS, 0) if k == 0 else (LINKS, LINKS * (k + 1))
        m = np.full((len(pdf), most), -1)
        for i in np.flatnonzero(level >= k):
            m[i] = pdf["links"].iat[i][skip : skip + most]
        layers.append(m)
    return Graph(x, level, layers)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row whose id is divisible by ``every``.

    Every row is indexed and is a candidate but for the query itself; ties go to the smaller id.
    Null, zero and non-finite vectors and null ids take no part; of repeated ids the smallest vector
    counts; vectors of another length are compared among themselves.  Of equal vectors the ``k + 1``
    smallest ids are kept, which are all that can be among the nearest.  An empty table gives none.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))  # the search works on unit vectors, scores on these
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    rows = staged(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    nodes = staged(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.size("v").alias("dim"), "ids", "v"), "nodes")
    shards = {r[0]: max(1, -(-r[1] // shard)) for r in nodes.groupBy("dim").count().collect()}  # a row for each length of vectors
    lookup = F.create_map(*[F.lit(x) for d, n in shards.items() for x in (d, n)]) if shards else F.create_map().cast("map<int,int>")
    dealt = nodes.select("dim", F.pmod(F.xxhash64(F.element_at("ids", 1)), lookup[F.col("dim")]).cast("int").alias("shard"), "ids", "v")
    index = staged(build(dealt), "graph")

    queries = rows.where(F.col("id") % every == 0).select(F.size("v").alias("dim"), F.col("id").alias("query_id"), F.col("v").alias("qv"))
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = queries.where(F.col("dim").isin(list(shards))).select("dim", F.explode(F.sequence(F.lit(0), lookup[F.col("dim")] - 1)).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "qv")
    index = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["dim", "shard", "block"]

    def run(own, ask):
        out: tuple[list, list, list] = ([], [], [])
        if len(own) and len(ask):
            own = own.sort_values("node", ignore_index=True)
            graph, raw = load(own), np.stack(own["v"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(raw, axis=1)
            q = np.stack(ask["qv"].to_numpy())
            ids = own["ids"].to_numpy()
            for name, qv, found in zip(ask["query_id"], q.astype(np.float64), graph.search(_unit(q), k + 3, beam)):
                found = found[found >= 0]
                score = raw[found] @ qv / (norm[found] * np.linalg.norm(qv))
                got = sorted((-s, i) for s, f in zip(score.tolist(), found) for i in ids[f] if i != name)[:k]
                for s, i in got:
                    for c, x in zip(out, (name, i, -s)):
                        c.append(x)
        return pd.DataFrame({"query_id": np.array(out[0], np.int64), "vec_id": np.array(out[1], np.int64), "score": np.array(out[2], float)})

    got = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
