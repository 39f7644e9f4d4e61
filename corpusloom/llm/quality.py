"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad.  Its potentials come from features of the line and of its neighbours, and
neighbouring labels from a transition table.  Forward-backward marginals of "good", weighted by line
length, give a document's raw quality, which a logistic curve turns into a probability.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .toxicity import sample

#: Labelled rows to learn from at most, taken by a hash of their ids.
SAMPLE = 6_000
#: Lines of a row that the fit takes at most; labelled rows with more are no part of it (all rows are scored).
FIT_LINES = 1_000
STEPS, RATE, DECAY = 160, 0.08, 1e-3
#: Lines that are held at once while scoring.
LINES = 20_000
_SYMBOL = re.compile(r"[^\w\s.,;:'\"()?-]")
_RUN = re.compile(r"([^\w\s])\1")
OWN = 16


def line_features(lines: list[str]) -> np.ndarray:
    """A row of ``OWN`` numbers for each line of one document; repeats are seen over the document."""
    out = np.zeros((len(lines), OWN), np.float32)
    count: dict[str, int] = {}
    for x in lines:
        count[x] = count.get(x, 0) + 1
    for i, x in enumerate(lines):
        n = len(x)
        if not n or x.isspace():
            out[i, 0] = 1
            continue
        words = x.split()
        m = len(words)
        symbols = len(_SYMBOL.findall(x))
        upper = sum(map(str.isupper, words))
        short = sum(len(w) <= 3 for w in words)
        ends = sum(w[-1] in ".,;:!?" for w in words)
        stops = sum(w[-1] in ".!?" for w in words)
        odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?'\")" for w in words)
        lone = sum(len(w) == 1 and not w.isalnum() for w in words)
        digits = sum(map(str.isdigit, x))
        distinct = len(set(words))
        out[i, 1:] = (
            np.log1p(n) / 6, np.log1p(m) / 4, min(n / m, 20) / 8, symbols / m, upper / m, short / m, ends / m, stops / m,
            odd / m, lone / m, digits / n, len(_RUN.findall(x)) / m, distinct / m, min(count[x] - 1, 5) / 5, float(x[-1] in ".!?\"'"),
        )
    return out


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zero outside), document means and a constant."""
    zero = np.zeros((1, own.shape[1]), own.dtype)
    before, after = np.concatenate([zero, own[:-1]]), np.concatenate([own[1:], zero])
    mean = np.repeat(own.mean(axis=0, keepdims=True), len(own), axis=0)
    return np.concatenate([own, before, after, mean, np.ones((len(own), 1), own.dtype)], axis=1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and lengths of a text's lines; an empty text has one empty line."""
    lines = (text or "").split("\n")
    return with_neighbours(line_features(lines)), np.array([len(x) for x in lines], float)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(emit: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of every line, expected transitions, and the log partition of all chains together.

    ``emit``: log potentials of both labels for all lines; chain ``i`` has ``size[i]`` lines from ``first[i]``.
    """
    alpha, beta = emit.astype(float).copy(), np.zeros_like(emit, dtype=float)
    order = np.argsort(-size, kind="stable")
    f, n = first[order], size[order]
    longest = int(n[0]) if len(n) else 0
    alive = [int(np.searchsorted(-n, -t, side="left")) for t in range(longest + 1)]  # chains with over t lines
    for t in range(1, longest):
        at = f[: alive[t]] + t
        alpha[at] += _lse(alpha[at - 1][:, :, None] + trans[None], 1)
    pair = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = f[: alive[t + 1]] + t
        beta[at] = _lse(trans[None] + (emit[at + 1] + beta[at + 1])[:, None, :], 2)
    z = _lse(alpha[f + n - 1], 1) if len(n) else np.zeros(0)
    of = np.empty(len(emit))
    np.put(of, np.arange(len(emit)), 0)
    for i, s, k in zip(range(len(f)), f, n):
        of[s : s + k] = z[i]
    inner = np.ones(len(emit), bool)
    inner[f + n - 1] = False
    at = np.flatnonzero(inner)
    if len(at):
        pair = np.exp(alpha[at][:, :, None] + trans[None] + (emit[at + 1] + beta[at + 1])[:, None, :] - of[at][:, None, None]).sum(axis=0)
    return np.exp(alpha + beta - of[:, None]), pair, float(z.sum())


class Field:
    """``w``: weights of "good" against "bad"; ``trans``: label transitions; ``a, b``: the logistic curve."""

    def __init__(self, w: np.ndarray, trans: np.ndarray, mean: np.ndarray, std: np.ndarray, a: float = 1.0, b: float = 0.0):
        self.w, self.trans, self.mean, self.std, self.a, self.b = w, trans, mean, std, a, b

    def raw(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length-weighted marginals of "good" by document, as log odds."""
        s = ((x - self.mean) / self.std) @ self.w
        good = forward_backward(np.stack([-s / 2, s / 2], axis=1), first, size, self.trans)[0][:, 1]
        weight = length + 1.0
        q = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        q = np.clip(q, 1e-6, 1 - 1e-6)
        return np.log(q / (1 - q))

    def lines(self, text: str | None) -> np.ndarray:
        """The marginal of "good" of each line of a text."""
        x, _ = features(text)
        s = ((x - self.mean) / self.std) @ self.w
        return forward_backward(np.stack([-s / 2, s / 2], axis=1), np.array([0]), np.array([len(x)]), self.trans)[0][:, 1]

    def scores(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush():
            size = np.array([len(x) for x, _ in held])
            z = self.raw(np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held]), np.cumsum(size) - size, size)
            out.extend((1 / (1 + np.exp(-np.clip(self.a * z + self.b, -40, 40)))).tolist())

        for t in texts:
            held.append(features(t))
            rows += len(held[-1][0])
            if rows >= LINES:
                flush()
                held, rows = [], 0
        if held:
            flush()
        return out


def fit(docs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, threshold: float = 0.3) -> Field:
    """Learns from documents whose lines all take the document's label.

    The curve is fitted to the labels and shifted so that ``threshold`` cuts where the two kinds of
    errors are evenly rare.  Without both classes every score is the mean.
    """
    y = np.asarray(label, int)
    width = 4 * OWN + 1
    n, pos = len(y), int(y.sum())
    if not n or pos in (0, n):
        rate = (pos + 0.5) / (n + 1)
        return Field(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width), 0.0, float(np.log(rate / (1 - rate))))
    size = np.array([len(x) for x, _ in docs])
    first = np.cumsum(size) - size
    x, length = np.concatenate([x for x, _ in docs]).astype(float), np.concatenate([m for _, m in docs])
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
    mean[-1], std[-1] = 0, 1
    xs = (x - mean) / std
    each = np.repeat(y, size)
    # a document counts once, however many lines it has
    weight = np.repeat(1.0 / np.sqrt(size), size)
    w, trans = np.zeros(width), np.zeros((2, 2))
    stays = np.zeros((2, 2))
    for c in (0, 1):
        stays[c, c] = (size[y == c] - 1).sum()
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    for step in range(1, STEPS + 1):
        s = xs @ w
        gamma, pair, _ = forward_backward(np.stack([-s / 2, s / 2], axis=1), first, size, trans)
        gw = xs.T @ ((gamma[:, 1] - each) * weight) / n + DECAY * w
        gt = (pair - stays) / max(1, stays.sum()) + 0.02 * trans
        rate = RATE * (1 - step / (STEPS + 1))
        for p, g, m, q in ((w, gw, state[0], state[1]), (trans, gt, state[2], state[3])):
            m += 0.1 * (g - m)
            q += 0.001 * (g * g - q)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-9)
    field = Field(w, trans, mean, std)
    z = field.raw(x, length, first, size)
    a, b = 1.0, 0.0
    for _ in range(60):  # logistic curve by Newton's method, slightly held to (1, 0)
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v = p * (1 - p)
        g = np.array([((p - y) * z).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
        h = np.array([[(v * z * z).sum() + 0.01, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
    o = np.argsort(z)
    cut = np.r_[z[o][0] - 1, (z[o][1:] + z[o][:-1]) / 2, z[o][-1] + 1]
    wrong_bad = np.r_[0, np.cumsum(y[o])]  # good documents below the cut
    wrong_good = (n - pos) - np.r_[0, np.cumsum(1 - y[o])]
    at = cut[int(np.argmin(wrong_bad / pos + wrong_good / (n - pos)))]
    field.a = float(max(a, 0.05))
    field.b = float(np.log(threshold / (1 - threshold)) - field.a * at)
    return field


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = SAMPLE, id_col: str = "doc_id", threshold: float = 0.3) -> Field:
    """Fits on at most ``most`` labelled rows of at most FIT_LINES lines; line features, and no texts, go to the driver."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                got = [(t or "").split("\n") for t in part.column(0).to_pylist()]
                own = [line_features(x).ravel() for x in got]
                size = [np.array([len(y) for y in x], np.int32) for x in got]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.float32())), pa.array(size, pa.list_(pa.int32())), part.column(1)], ["own", "size", "label"])

    rows = sample(docs, labels, label_col, most, id_col)
    rows = rows.where(F.length(F.translate(F.coalesce("text", F.lit("")), "\n", "")) > F.length(F.coalesce("text", F.lit(""))) - F.lit(FIT_LINES))
    got = rows.mapInArrow(run, "own array<float>, size array<int>, label int").toArrow().to_pydict()
    rows = [(np.array(o, np.float32).reshape(-1, OWN), np.array(s, float), y) for o, s, y in zip(got["own"], got["size"], got["label"])]
    rows.sort(key=lambda r: (zlib.crc32(r[0].tobytes()), r[2]))  # not as the tasks ended
    return fit([(with_neighbours(o), s) for o, s, _ in rows], np.array([y for *_, y in rows], int), threshold)


def scorer(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, most: int = SAMPLE) -> Column:
    """The score of ``text_col`` by a field trained on the labelled rows of ``docs``."""
    named = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    field = docs.sparkSession.sparkContext.broadcast(train(named, labels, label_col, most, id_col, threshold))

    @F.pandas_udf("double")
    def run(text):
        import pandas as pd

        return pd.Series(field.value.scores(list(text)), index=text.index, dtype=float)

    return run(F.coalesce(docs[text_col], F.lit("")))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, most: int = SAMPLE) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``.

    Only whole texts make scores.  Null texts count as empty: one empty line; repeated rows get equal
    scores; a null doc_id counts as the empty string in ``held_out``; further columns are ignored; an
    empty table gives no rows.
    """
    value = scorer(docs, labels, label_col, id_col, text_col, threshold, most)
    rest = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), (rest == 0).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
