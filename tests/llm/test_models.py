import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import quality, suffix_lm, toxicity

DOCS = "doc_id long, text string, label int, score double, toxic string"


def held(i, mod=5):
    return zlib.crc32(str(i).encode()) % mod


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 9, 0.5, "x") for i, t in rows], DOCS)


# toxicity


def test_machine_sums_all_pairs():
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta"]
    terms = np.unique([h for w in words for h in toxicity.term_hashes(w)])
    m = toxicity.Machine(terms, 0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 3)))
    for n in range(len(words) + 1):
        text = " ".join(words[:n])
        x = sorted({m.at[h] for w in words[:n] for h in toxicity.term_hashes(w)})
        z = 0.3 + sum(m.w[i] for i in x) + sum(m.v[i] @ m.v[j] for i, j in itertools.combinations(x, 2))
        assert m.score(text.upper()) == pytest.approx(1 / (1 + math.exp(-z)))


def pairs_of_words(n, seed):
    """Toxic only where both words meet; neither word tells alone."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(["one", "two", "three", "four", "five"]) for _ in range(8)] + ["hateful"] * a + ["group"] * b
        rng.shuffle(text)
        out.append((i, " ".join(text), int(a and b)))
    return out


def test_interactions_are_learnt_and_held_out_rows_are_right(spark):
    rows = pairs_of_words(900, 1)
    docs, labels = frame(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) and all(r.held_out == (held(r.doc_id) == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out]
    assert sum(right) / len(right) > 0.97


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_rows(spark, module):
    label = "toxic" if module is toxicity else "quality"
    rows = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (None, "a b"), (5, "word " * 60_000), (6, "\n\n \n")]
    for labels in ([], [(1, 1), (4, 1), (7, 0)], [(1, 1), (2, 0), (3, None), (4, 0), (None, 1), (5, 0), (6, 1)]):
        table = spark.createDataFrame(labels, f"doc_id long, {label} int")
        got = {r.doc_id: r for r in module.score(frame(spark, rows), table).collect()}
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
        assert got[2].score == got[3].score and got[1].score == got[4].score == got[None].score
    assert module.score(frame(spark, []), spark.createDataFrame([], f"doc_id long, {label} int")).count() == 0


# quality


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(3)
    sizes = np.array([4, 1, 3, 5])
    first = np.cumsum(sizes) - sizes
    emit, trans = rng.normal(size=(sizes.sum(), 2)), rng.normal(size=(2, 2))
    got, pair, z = quality.forward_backward(emit, first, sizes, trans)
    want, want_pair, want_z = np.zeros_like(emit), np.zeros((2, 2)), 0.0
    for f, n in zip(first, sizes):
        every = list(itertools.product((0, 1), repeat=int(n)))
        score = np.array([sum(emit[f + t, y[t]] for t in range(n)) + sum(trans[y[t], y[t + 1]] for t in range(n - 1)) for y in every])
        p = np.exp(score - score.max())
        want_z += math.log(p.sum()) + score.max()
        for y, q in zip(every, p / p.sum()):
            for t in range(n):
                want[f + t, y[t]] += q
            for t in range(n - 1):
                want_pair[y[t], y[t + 1]] += q
    assert np.allclose(got, want) and np.allclose(pair, want_pair) and z == pytest.approx(want_z)


def test_quality_of_held_out_rows(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        good = rng.random() < 0.7
        line = lambda: " ".join(rng.choice(["the", "river", "went", "slowly", "down", "valley", "again"]) for _ in range(9)) + "." if good else "".join(rng.choice("#$% 12!A") for _ in range(40))
        rows.append((i, "\n".join(line() for _ in range(rng.randrange(1, 6))), int(good)))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = quality.score(frame(spark, [(i, t) for i, t, _ in rows]), labels).collect()
    truth = {i: y for i, _, y in rows}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out]
    assert len(right) > 50 and sum(right) / len(right) > 0.97


def test_batches_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(2)
    field = quality.Field(rng.normal(size=4 * quality.OWN + 1), rng.normal(size=(2, 2)), np.zeros(4 * quality.OWN + 1), np.ones(4 * quality.OWN + 1))
    texts = ["a b.\nc d\n\n###", None, "x" * 500, "one\n" * 40]
    want = [field.scores([t])[0] for t in texts]
    monkeypatch.setattr(quality, "LINES", 3)
    assert np.allclose(field.scores(texts), want)


# suffix tree


def tokens_of(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode()) + [b"\n"]


def plain_scores(rows, depth=None):
    """``(held out, tokens, known, training tokens, base, score)`` of each row by dictionaries of counts."""
    depth = depth or suffix_lm.DEPTH
    train = [(i, tokens_of(t)) for i, t in rows if held(i, 7) != 2]
    c = Counter(w for _, d in train for w in d)
    n, v = sum(c.values()), len(c)
    least = max(2, n * suffix_lm.WORD_SHARE)
    often = {w: (k + 1) / (n + v + 1) for w, k in c.items() if k >= least}
    rare = (1 - sum(often.values())) / (v - len(often) + 1) if n else 1.0
    u = lambda x: np.array([x], np.uint64)

    def contexts(i, d, at):
        """Contexts of one to ``depth`` words; that of a frequent word has a class."""
        before = [d[at - k] if at >= k else b"\n" for k in range(1, depth + 1)]
        parts = -(-c[before[0]] // max(1, suffix_lm.BUCKET // 2)) if before[0] in often else 1
        of = suffix_lm.word_hash(before[1]) if at else np.array([i], np.int64).view(np.uint64)[0]
        cls = int(suffix_lm.mixed(u(of), u(0))[0]) % parts if parts > 1 else 0
        return [(cls, *before[:k]) for k in range(1, depth + 1)]

    counts = defaultdict(Counter)
    for i, d in train:
        for at, w in enumerate(d):
            for x in contexts(i, d, at):
                counts[x][w] += 1

    def prob(ctx, w, retained):
        p = often.get(w, rare)
        for x in ctx:
            if x in counts and (retained is None or x in retained):
                p = (counts[x][w] + len(counts[x]) * p) / (sum(counts[x].values()) + len(counts[x]))
        return p

    keep = set()
    for x in counts:
        chain = [x[: k + 2] for k in range(len(x) - 1)]
        gain = sum(m * math.log(prob(chain, w, None) / prob(chain[:-1], w, None)) for w, m in counts[x].items())
        if gain >= suffix_lm.DIVERGENCE:
            keep.update(chain)
    out = {}
    for i, t in rows:
        d = tokens_of(t)
        score = sum(math.log10(prob(contexts(i, d, at), w, keep)) for at, w in enumerate(d))
        base = sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in d)
        out.setdefault(i, []).append((held(i, 7) == 2, len(d), sum(c[w] > 0 for w in d), n, round(base, 6), round(score, 6)))
    return {k: sorted(x) for k, x in out.items()}


def lm_scores(spark, rows):
    out = {}
    for r in suffix_lm.score(frame(spark, rows)).collect():
        out.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)))
    return {k: sorted(x) for k, x in out.items()}


@pytest.mark.parametrize(("bucket", "share", "docs"), [(1_000_000, 2.0**-22, 30_000), (60, 2.0**-22, 7), (200, 0.01, 3)])
def test_scores_against_a_plain_tree(spark, monkeypatch, bucket, share, docs):
    monkeypatch.setattr(suffix_lm, "BUCKET", bucket)
    monkeypatch.setattr(suffix_lm, "WORD_SHARE", share)
    monkeypatch.setattr(suffix_lm, "PACK_DOCS", docs)
    monkeypatch.setattr(suffix_lm, "CACHE_WORDS", 50)
    rng = random.Random(8)
    vocab = ["The", "cat", "sat", "on", "a", "mat", "naïve", "dog's", "42"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(100, None), (101, ""), (3, "Again\x0b and\tagain  zebra"), (102, "the the " * 400)]
    rows += [(200 + i, f"common word{i % 7} rare{i} common passage that is seen again and again") for i in range(20)]
    got, want = lm_scores(spark, rows), plain_scores(rows)
    assert set(got) == set(want)
    for i in want:
        for a, b in zip(got[i], want[i], strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-3, rel=1e-5)


def whole_scores(rows):
    """``(held out, tokens, score)`` of each row, every state by all its occurrences and every word by its count."""
    train = [tokens_of(t) for i, t in rows if held(i, 7) != 2]
    c = Counter(w for d in train for w in d)
    z = sum(c.values()) + len(c) + 1

    def contexts(d, at):
        before = [d[at - k] if at >= k else b"\n" for k in range(1, suffix_lm.DEPTH + 1)]
        return [tuple(before[:k]) for k in range(1, suffix_lm.DEPTH + 1 if at else 2)]

    counts = defaultdict(Counter)
    for d in train:
        for at, w in enumerate(d):
            for x in contexts(d, at):
                counts[x][w] += 1

    def prob(ctx, w, retained=None):
        p = (c[w] + 1) / z
        for x in ctx:
            if x in counts and (retained is None or x in retained):
                p = (counts[x][w] + len(counts[x]) * p) / (sum(counts[x].values()) + len(counts[x]))
        return p

    keep, forced = set(), 0
    for x in sorted(counts, key=len, reverse=True):
        chain = [x[: k + 1] for k in range(len(x))]
        gain = sum(m * math.log(prob(chain, w) / prob(chain[:-1], w)) for w, m in counts[x].items())
        if gain >= suffix_lm.DIVERGENCE:
            keep.update(chain)
        forced += x in keep and gain < suffix_lm.DIVERGENCE
    out = {}
    for i, t in rows:
        d = tokens_of(t)
        out.setdefault(i, []).append((held(i, 7) == 2, len(d), sum(math.log10(prob(contexts(d, at), w, keep)) for at, w in enumerate(d))))
    return {k: sorted(x) for k, x in out.items()}, forced


@pytest.mark.parametrize(("bucket", "share", "docs", "turns"), [(1_000_000, 2.0**-22, 30_000, 0), (60, 0.02, 7, 0), (8, 0.01, 50, 0), (8, 0.1, 50, 30)])
def test_the_query_learns_from_all_occurrences(spark, monkeypatch, tmp_path, bucket, share, docs, turns):
    from corpusloom.llm.queries import QUERIES

    monkeypatch.setattr(suffix_lm, "BUCKET", bucket)
    monkeypatch.setattr(suffix_lm, "WORD_SHARE", share)
    monkeypatch.setattr(suffix_lm, "PACK_DOCS", docs)
    monkeypatch.setattr(suffix_lm, "ASKS", 300, raising=False)
    rng = random.Random(5)
    vocab = ["The", "cat", "sat", "on", "a", "mat", "naïve", "dog's", "42"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(100, None), (101, ""), (3, "Again and again  zebra")]
    rows += [(200 + i, f"common word{i % 7} rare{i} common passage that is seen again and again rare{i // 2} unseen{i}") for i in range(30)]
    if turns:  # the word before tells nothing alone
        rows = [(i, text) for i, text in zip((next(j for j in range(9) if held(j, 7) != 2), next(j for j in range(99) if held(j, 7) == 2)), ("a a b b " * turns, "b b a a c"))]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["op8_suffix_tree_lm"](spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.score))
    want, forced = whole_scores(rows)
    assert set(got) == set(want) and (forced or not turns)
    for i in want:
        for a, b in zip(sorted(got[i]), want[i], strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-3, rel=1e-5)


def test_next_words_sum_to_one():
    rng = np.random.default_rng(3)
    n, words = 400, 12
    w = rng.integers(0, words, n).astype(np.uint64)
    ctx = [suffix_lm.mixed(np.roll(w, 1), np.zeros(n, np.uint64))]
    ctx.append(suffix_lm.mixed(ctx[0], np.roll(w, 2)))
    p0 = np.full(words, 1 / words)
    for i in (5, 77, 300):  # each word in turn after the words before place i, not learnt from
        more = [np.concatenate([c, np.full(words, c[i])]) for c in ctx]
        value = suffix_lm.score_bucket(more, np.concatenate([w, np.arange(words, dtype=np.uint64)]), np.concatenate([p0[w.astype(int)], p0]), np.arange(n + words) < n)
        assert (10 ** value[n:]).sum() == pytest.approx(1)


def test_scores_of_nothing(spark):
    assert suffix_lm.score(frame(spark, [])).count() == 0
    only_held = next(i for i in range(100) if held(i, 7) == 2)
    r = suffix_lm.score(frame(spark, [(only_held, "a b")])).head()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_held_out_scores_are_above_the_base(spark, sf):
    import os

    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    rows = suffix_lm.score(spark.read.parquet(path)).where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").head()
    assert rows.s > rows.b + 0.3
