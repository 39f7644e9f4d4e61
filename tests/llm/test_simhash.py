import itertools
import random
import re

import numpy as np
import xxhash

from corpusloom.llm import simhash
from corpusloom.llm._common import components


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    votes = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def plain_components(fps, tau=3):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= tau:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_cases():
    for t in (None, "", " \t\n", "One", "one  TWO", "a b c", "Ä É a b \x0b c d", "w " * 70_000 + "x y", "\x1c a b c"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 200, 400]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "other"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "  ")]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(fps)
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in rows + [(900, None)]], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_groups(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (int(r.fingerprint, 16), len(r.fingerprint), r.component_id) == (fps[r.doc_id], 16, want[r.doc_id])


def test_links_on_random_bits_and_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(12):
            f = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                f ^= 1 << int(bit)
            fps.add(f)
    for k in itertools.combinations(range(12), 2):  # a crowd around zero
        fps.add((1 << k[0]) | (1 << k[1]))
    fps = {i: f for i, f in enumerate(sorted(fps))}
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in fps.items()]
    want = plain_components(fps)
    for hot in (simhash.HOT_BUCKET, 8):
        monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
        roots = dict(components(simhash.links(spark.createDataFrame(rows, "fp long, rep long"))).collect())
        assert {i: roots.get(i, i) for i in fps} == want


def test_thresholds_cover_every_pair():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for m in (2, 3, 4):
        order = [list(range(i, 64, m)) for i in range(m)]
        plan = simhash.Plan(order, 3, len(fp))
        plan.learn({(i, j): np.bincount(plan.gather(fp, b).astype(int), minlength=1 << len(b)) for i, g in enumerate(plan.slices) for j, b in enumerate(g)})
        t = plan.allocate(fp)
        assert (t.sum(axis=1) == 3 - m + 1).all() and (t >= -1).all()


def test_nothing_and_nulls(spark):
    kind = "doc_id long, text string"
    assert simhash.near_groups(spark.createDataFrame([], kind)).count() == 0
    got = simhash.near_groups(spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "quite another text here")], kind)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, None), (5, 5), (5, 5)]
    kept = simhash.keep_one(spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "z y x w")], kind))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 150), 100)}
