import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = [" ", "  ", "\n", "\t", "'s", "'ll", "a", "aaa", "é", "ß", "中文", "日", "😀", "́", "12", "!!", "---", "\xa0", "\x85", "\x1c", "　", "don't", " the", "$", "\r\n", "|", "\x00", "İ", "Ⅷ"]


def reference(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)] + ["-" * k for k in (1, 63, 999)] + ["a b " * 40_000]


def test_chunked_encoding_equals_the_whole():
    enc, want = bpe.Encoder(MULTI), reference(MULTI)
    for t in texts(3000):
        assert np.frombuffer(enc.packed([t])[0], "<u4").tolist() == want.encode_ordinary(t)
        assert "".join(bpe.chunks(t)) == t


def test_both_libraries_agree_on_the_packed_vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    fast = bpe.Encoder(path, fast=True)
    for t in texts(1500, 2) + ["<|endoftext|> x"]:
        assert np.frombuffer(fast.packed([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_round_trip_and_offsets(spark):
    rows = [(i, t, 1) for i, t in enumerate(["naïve café", "", None, "日本 😀 x", "a" * 5000])] + [(0, "naïve café", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    want = reference(MULTI)
    got = bpe.round_trip(df, MULTI).collect()
    assert len(got) == 6
    by = {i: t or "" for i, t, _ in rows}
    for r in got:
        ids = want.encode_ordinary(by[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(by[r.doc_id].encode()).hexdigest()
    enc = bpe.encode(df, MULTI)
    for r in enc.collect():
        t = by[r.doc_id]
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert all(0 <= a <= b <= len(t) for a, b in zip(r.starts, r.ends)) and (not t or max(r.ends) == len(t))
    assert {r.doc_id: r.text for r in bpe.decode(enc, MULTI).collect()} == by
    half = spark.createDataFrame([(1, want.encode_ordinary("😀")[:1])], "doc_id long, ids array<int>")
    assert "�" in bpe.decode(half, MULTI).head().text
    assert bpe.round_trip(df.limit(0), MULTI).count() == 0


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_local_search_only_helps():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 60))]
        start = packing.best_fit(lengths, 100)
        end = packing.local_search([list(b) for b in start], lengths, 100)
        assert sorted(i for b in end for i in b) == list(range(len(lengths)))
        square = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
        assert all(sum(lengths[i] for i in b) <= 100 for b in end) and len(end) <= len(start) and square(end) >= square(start)
        assert not any(helps(end, lengths, 100))


def helps(bins, lengths, size):
    """Tries every move, exchange and two-for-one exchange between bins with room: whether it raises the squares."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for a, own in enumerate(bins):
        for b, other in enumerate(bins):
            if a != b and fill[a] < size and fill[b] < size:
                give = [(lengths[i],) for i in own] + [(lengths[i], lengths[j]) for k, i in enumerate(own) for j in own[k + 1 :]]
                for g in give:
                    for back in [lengths[j] for j in other] + [0] * (len(g) == 1):
                        gain = sum(g) - back
                        yield 0 < gain <= size - fill[b] and (fill[a] - gain) ** 2 + (fill[b] + gain) ** 2 > fill[a] ** 2 + fill[b] ** 2


def test_local_search_empties_bins():
    # the two pieces of the emptiest bin fill the others for a shorter one, which then moves
    assert len(packing.local_search([[0, 1], [2, 3], [4]], [60, 30, 50, 40, 20], 100)) == 2
    rng = random.Random(5)
    lengths = [rng.randrange(300, 900) for _ in range(4000)]
    start = packing.best_fit(lengths, 2048)
    assert len(packing.local_search([list(b) for b in start], lengths, 2048)) < len(start)


def test_packing_end_to_end(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma's", "delta,"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 3000), (5, rows[5][1])]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, length int")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for group in (packing.GROUP, 40):
        got = packing.pack_documents(df, path, size=128, group=group).collect()
        by, text = {}, {i: t or "" for i, t in rows}
        for r in got:
            by.setdefault(r.sequence_id, []).append(r)
            ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids + [0]
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and (r.piece == 0 or r.length == 128)
        for rs in by.values():
            at = 0
            for r in sorted(rs, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 128
        total = sum(r.length for r in got)
        assert total == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
        assert len(by) <= 1.1 * total / 128 + 2
    assert packing.pack_documents(df.limit(0), path).count() == 0
    seq = packing.sequences(packing.place(packing.pieces(df, path, 128, keep_ids=True), 128)).collect()
    assert sum(len(r.ids) for r in seq) == total and max(len(r.ids) for r in seq) <= 128


def test_packing_encodes_added_tokens_as_the_tokenizers_file(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice([*PARTS, "<|endoftext|>", "<|endoftext", "|>"]) for _ in range(rng.randrange(20)))) for i in range(400)] + [(900, "<|endoftext|>"), (901, None)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    for fast in (True, False):
        got = {r.doc_id: list(r.ids) for r in packing.pieces(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True, fast=fast).collect()}
        assert got == want
    got = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
