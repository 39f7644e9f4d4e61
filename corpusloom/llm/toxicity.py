"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-case words and the first four to eight characters of longer words,
hashed to ``BITS`` bits.  Training keeps the hashed terms that tell the classes apart best and learns
a weight and a short factor for each; the factors give every pair of terms, such as an insult and the
mention of a group, a weight of its own.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows to learn from at most, taken by a hash of their ids.
SAMPLE = 12_000
BITS, TERMS, FACTORS = 18, 1536, 6
EPOCHS, BATCH, RATE, DECAY = 24, 256, 0.02, 2e-4
#: Few rows are gone through more often, up to so many steps.
STEPS = 600
#: A toxic row counts as so many others, as these are few.
TOXIC_WEIGHT = 4.0
PREFIXES = (4, 5, 6, 7, 8)
CACHE_WORDS = 400_000
_WORD = re.compile(r"\w+")


def term_hashes(word: str) -> list[int]:
    own = [word] + [word[:k] + "*" for k in PREFIXES if len(word) > k]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in own]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Machine:
    """``bias + sum w + sum of <v_i, v_j> over pairs`` of the kept terms of a text, then a logistic."""

    def __init__(self, terms: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.at = {int(t): i for i, t in enumerate(terms)}
        self.bias, self.w, self.v = bias, w, v
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        known = self.known
        for word in words(text):
            got = known.get(word)
            if got is None:
                got = tuple(self.at[h] for h in term_hashes(word) if h in self.at)
                if len(known) >= CACHE_WORDS:
                    known.clear()
                known[word] = got
            if got:
                found.update(got)
        x = sorted(found)
        v = self.v[x]
        z = self.bias + self.w[x].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[np.ndarray], label: np.ndarray, seed: int = 7) -> Machine:
    """Learns from the distinct term hashes of each text.  Without both classes every score is the mean."""
    y = np.asarray(label, np.float32)
    n, pos = len(y), float(y.sum())
    if not n or pos in (0, n):
        rate = (pos + 0.5) / (n + 1)
        return Machine(np.zeros(0, np.int64), float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, FACTORS)))
    size = 1 << BITS
    at = np.concatenate(rows)
    of = np.repeat(y, [len(r) for r in rows])
    there, hits = np.bincount(at, minlength=size).astype(float), np.bincount(at, of, size)
    expected = there * pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(there >= 3, (hits - expected) ** 2 / (expected * (1 - pos / n) * (1 - there / n) + 1e-9), 0)
    terms = np.sort(np.argsort(-chi, kind="stable")[:TERMS])
    terms = terms[chi[terms] > 4]
    index = np.full(size, -1)
    index[terms] = np.arange(len(terms))
    x = np.zeros((n, len(terms)), np.float32)
    for i, r in enumerate(rows):
        j = index[r]
        x[i, j[j >= 0]] = 1
    rng = np.random.default_rng(seed)
    weight = np.where(y > 0, TOXIC_WEIGHT, 1.0).astype(np.float32)
    w, v, bias = np.zeros(len(terms), np.float32), rng.normal(0, 0.02, (len(terms), FACTORS)).astype(np.float32), float(np.log(TOXIC_WEIGHT * pos / (n - pos)))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)] + [[np.zeros(1), np.zeros(1)]]
    b, step = np.array([bias]), 0
    epochs = max(EPOCHS, -(-STEPS // -(-n // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            part = order[s : s + BATCH]
            xb = x[part]
            xv = xb @ v
            z = b[0] + xb @ w + 0.5 * (xv**2 - xb @ v**2).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / weight[part].sum()
            gw = xb.T @ g
            gv = xb.T @ (g[:, None] * xv) - gw[:, None] * v
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for p, gp, (m, q) in zip((w, v, b), (gw + DECAY * w, gv + DECAY * v, np.array([g.sum()])), state):
                m += 0.1 * (gp - m)
                q += 0.001 * (gp**2 - q)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    return Machine(terms, float(b[0]), w.astype(float), v.astype(float))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", mod: int = 5) -> DataFrame:
    """``(text, label)`` of at most ``most`` labelled rows that are not held out, by a hash of the id.

    Of several documents with one id the smallest text counts, so that no id brings more than a row.
    """
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    mine = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.encode(ids, "UTF-8")) % mod != 0))
    mine = mine.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    mine = mine.orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.select(F.col(id_col).alias("_id"), "text").join(F.broadcast(mine), "_id").groupBy("_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = SAMPLE, id_col: str = "doc_id") -> Machine:
    """Fits on at most ``most`` labelled rows; their hashed terms, and no texts, go to the driver."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = [sorted({h for w in words(t) for h in term_hashes(w)}) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), part.column(1)], ["terms", "label"])

    got = sample(docs, labels, label_col, most, id_col).mapInArrow(run, "terms array<int>, label int").toArrow()
    terms = got.column(0).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    flat, cuts = terms.flatten().to_numpy(), np.cumsum(np.asarray(terms.value_lengths()))
    rows, label = np.split(flat, cuts[:-1]) if got.num_rows else [], np.asarray(got.column(1).to_pylist(), int)
    order = sorted(range(len(rows)), key=lambda i: (zlib.crc32(rows[i].tobytes()), label[i]))  # not as the tasks ended
    return fit([rows[i] for i in order], label[order])


def scorer(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Column:
    """The score of ``text_col`` by a machine trained on the labelled rows of ``docs``."""
    named = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    machine = docs.sparkSession.sparkContext.broadcast(train(named, labels, label_col, most, id_col))

    @F.pandas_udf("double")
    def run(text):
        m = machine.value
        return text.map(m.score).astype(float) if len(text) else text.astype(float)

    return run(F.coalesce(docs[text_col], F.lit("")))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``.

    Only whole texts make scores.  Null texts count as empty and get the score of a text without
    known terms; repeated rows get equal scores; a null doc_id counts as the empty string in
    ``held_out``; further columns are ignored; an empty table gives no rows.
    """
    value = scorer(docs, labels, label_col, id_col, text_col, most)
    rest = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), (rest == 0).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
