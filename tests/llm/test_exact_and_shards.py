import hashlib
import zlib

import pytest

from corpusloom.llm import exact_dedup, shards

SCHEMA = "doc_id long, text string, h long, grp int, bucket int, shard int, size long, lang string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, "en") for i, t in rows], SCHEMA)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "x" * 300_000), (8, "x" * 300_000), (9, "a "), (9, "a "), (None, "a")]


@pytest.mark.parametrize(("keys", "hot"), [(exact_dedup.BROADCAST_KEYS, 1000), (0, 1000), (0, 1)])
def test_exact_against_brute_force(spark, monkeypatch, keys, hot):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 1)
    monkeypatch.setattr(exact_dedup, "HOT_KEYS", hot)
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", keys)
    got = exact_dedup.duplicates(docs(spark, ROWS), capacity=2).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    by = {(r.doc_id, r.text_sha256) for r in got}
    for i, t in ROWS:
        assert (i, hashlib.sha256((t or "").encode()).hexdigest()) in by
    for r in got:
        own = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        most = max(x for x in own if x is not None)
        assert (r.keep_id, r.group_size, r.kept) == (most, len(own), r.doc_id == most)


def test_exact_empty_and_keep_one(spark):
    assert exact_dedup.duplicates(docs(spark, [])).count() == 0
    kept = exact_dedup.keep_one(docs(spark, ROWS))
    assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 8, 9, 9]


def test_directory_doubles_for_overfull_buckets_only():
    got = exact_dedup.directory({0: 10, 1: 10, 8: 1}, capacity=10, max_depth=4)
    assert got == [(4, 0), (4, 1), (3, 1), (2, 1), (1, 1)]
    assert exact_dedup.directory({3: 99}, capacity=10, max_depth=4) == [(3, 0), (4, 2), (4, 3), (2, 1), (1, 1)]  # a chain of one cell stays


def test_shards_are_even_and_whole(spark):
    rows = [(i, f"text {i} " * (i % 37 + 1)) for i in range(3000)] + [(10_000 + i, "copy of a passage") for i in range(200)] + [(20_000, None), (20_001, ""), (20_001, "")]
    got = shards.shard(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size, where, slots, groups = {}, {}, {}, {}
    text = dict(rows)
    for r in got:
        t = text[r.doc_id] or ""
        assert r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r.slot)
        groups.setdefault(t, set()).add(r["shard"])
        where[r.doc_id] = r["shard"]
    assert set(size) == set(range(16))
    mean = sum(size.values()) / 16
    assert max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())


def test_shards_split_a_group_that_holds_a_third(spark):
    rows = [(i, f"{i} some text of its own") for i in range(1200)] + [(10_000 + i, "the same text again, all over") for i in range(600)]
    size = {}
    for r in shards.shard(docs(spark, rows)).collect():
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert len(size) == 16 and max(size.values()) < 1.1 * sum(size.values()) / 16


def test_shards_of_nothing(spark):
    assert shards.shard(docs(spark, [])).count() == 0
    assert [r["shard"] for r in shards.shard(docs(spark, [(None, None)])).collect()][0] in range(16)
    with pytest.raises(ValueError):
        shards.shard(docs(spark, []), 12)


def test_keep_one_with_any_column_names(spark):
    from corpusloom.llm import simhash

    rows = [(1, "one two three four", 1, "x"), (2, "one two three four", 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id long, gone_sha string")
    assert [r.doc_id for r in exact_dedup.keep_one(df).collect()] == [2]
    assert [r.doc_id for r in simhash.keep_one(df).collect()] == [1]


def test_index_lies_by_bucket_and_owner_ranges_need_no_second_exchange(spark):
    rows = [(i, f"text {i % 60}") for i in range(200)]
    keyed = docs(spark, rows).selectExpr("doc_id", "xxhash64(text) as h")
    index = exact_dedup.build_index(keyed, capacity=10).collect()
    assert len(index) == 60 and sum(r.entries for r in index) == 200
    by = {}
    for r in index:
        by.setdefault(r.bucket, []).append(r)
    assert len(by) > 4 and all(len(b) <= 10 for b in by.values())


def test_staged_folder_is_never_local_on_a_cluster():
    from types import SimpleNamespace

    from corpusloom.llm import _common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None), sparkContext=SimpleNamespace(master="spark://h:7077"))
    with pytest.raises(ValueError):
        _common.shared_folder(session)
    session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        _common.shared_folder(session)


@pytest.mark.parametrize("most", [1000, 1])
def test_components_with_hot_nodes(spark, monkeypatch, most):
    from corpusloom.llm import _common

    monkeypatch.setattr(_common, "HOT_KEYS", most)

    edges = [(i, 5) for i in range(6, 60)] + [(300 + i, 299) for i in range(1, 20)] + [(60 + i, 61 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in _common.components(spark.createDataFrame(edges, "a long, b long"), hot_node=10).collect()}
    assert got == {i: 5 for i in range(6, 60)} | {i: 60 for i in range(61, 91)} | {i: 299 for i in range(301, 320)}
