"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of one to ``DEPTH`` words before a token.  A context is retained if the divergence
of its next-word distribution from that of its suffix, weighted by its count, passes a test, or if a
longer retained one needs it; nothing else leaves the tree.  Distributions are smoothed towards the
suffix by the number of distinct next words (Witten-Bell), down to the distribution of single words,
and each token is scored in its longest retained suffix state.

The tree is never in one place.  Every occurrence of a token goes, with the words before it, to the
bucket of its last context word, as packed columns, so a bucket holds all states that end in that word
and their counts, prunes them, scores its occurrences and sends sums for each document back.  A word
with more than half a bucket of occurrences is split by the word before it: its one-word state becomes
as many states as half buckets, each for a class of preceding words (document starts are split by
document).  Single words are counted, and rare ones looked up, in buckets of their own, and so what is
gathered grows with the corpus and lies evenly; tasks share the words of at least ``WORD_SHARE`` of all
tokens only.

With ``whole`` the classes only deal out work: the counts of each pair of a split word and a next word
are summed in buckets of pairs, the counts of rare words looked up with the single words, and both are
sent to the buckets that ask for them.  Every state then has the counts of all its occurrences, and
every word its own count.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged
from .bpe import small_lists
from .simhash import LOWER

#: Words of the longest contexts.
DEPTH = 3
#: Occurrences to a bucket of contexts, about, and buckets of single words.
BUCKET, WORD_BUCKETS = 800_000, 128
#: Tokens and documents that a task packs at once; document numbers take 15 bits.
PACK_TOKENS, PACK_DOCS = 1_000_000, 30_000
#: Least count times divergence (nats) from the suffix state that keeps a context.
DIVERGENCE = 3.0
#: Words with at least this share of all tokens are known to the tasks; there are 2^22 at most.
WORD_SHARE = 2.0**-22
#: Words that a worker remembers.
CACHE_WORDS = 300_000
#: Characters of text handled at once.
CHUNK = 1_000_000
#: Pairs that a task sums up at once.
ASKS = 2_000_000
END = b"\n"
_U = np.uint64
_LOW40 = _U((1 << 40) - 1)
#: Ranks of frequent words lie below; others are marked by a bit above the 40 of their hash, and in packed columns lie apart.
_RANKS, _OTHER, _ESCAPE = _U(1 << 22), _U(1 << 40), _U((1 << 24) - 1)
#: In place of a split word's number: counts of rare words.
_RARE_WORDS = _U((1 << 23) - 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w, 42)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two columns of numbers."""
    with np.errstate(over="ignore"):
        x = a * _U(0x9E3779B97F4A7C15) + b
        for m in (0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93):
            x = (x ^ (x >> _U(32))) * _U(m)
    return x ^ (x >> _U(32))


def _pack(*columns: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(c).tobytes() for c in columns]
    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, "<u4", len(kinds) + 1)[1:].tolist()
    at, out = 4 * (len(kinds) + 1), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at) if size else np.zeros(0, kind))
        at += size
    return out


def _low(x: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of each number, one number after the other."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :size]


def _from_low(x: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(x) // size, 8), np.uint8)
    out[:, :size] = x.reshape(-1, size)
    return out.view(np.uint64).ravel()


def _planes(x: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of all numbers, byte by byte, so that high bytes, nearly all zero, lie together."""
    return _low(x, size).T


def _from_planes(x: np.ndarray, size: int) -> np.ndarray:
    return _from_low(np.ascontiguousarray(x.reshape(size, -1).T).ravel(), size)


def _rising(x: np.ndarray, size: int = 5) -> np.ndarray:
    """Steps of numbers that mostly rise, modulo their size."""
    return _planes(np.diff(x, prepend=_U(0)), size)


def _from_rising(x: np.ndarray, size: int = 5) -> np.ndarray:
    return np.cumsum(_from_planes(x, size), dtype=np.uint64) & _U((1 << 8 * size) - 1)


def _words(x: np.ndarray, pack) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, with an escape for other words, and the hashes of those."""
    return pack(np.minimum(x, _ESCAPE), 3), _low(x[x >= _OTHER], 5)


def _from_words(parts: list[list[np.ndarray]], unpack) -> np.ndarray:
    x = np.concatenate([unpack(p[0], 3) for p in parts])
    x[x == _ESCAPE] = np.concatenate([_from_low(p[1], 5) for p in parts]) | _OTHER
    return x


def word_bucket(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(32)) * _U(WORD_BUCKETS)) >> _U(32)


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(key, kind="stable")
    key, n = key[o], n[o]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _pair_sums(key: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by key and bucket, sorted by both."""
    o = np.argsort(key)
    group = np.cumsum(np.diff(key[o], prepend=key[o[:1]]) != 0)
    o = o[np.argsort((group << 32) | b[o])]
    key, b, n = key[o], b[o], n[o]
    at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (b[1:] != b[:-1])]) if len(key) else np.zeros(0, np.int64)
    return key[at], b[at], np.add.reduceat(n, at) if len(at) else n


def _batch(schema: str, **columns) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f], types[t]) if f in columns else pa.nulls(n, types[t]) for f, t in fields], [f for f, _ in fields])


# single words

_WORDS = "bucket int, n long, total long, data binary"


def _count_words(batches):
    """Counts of the words of training rows, packed by word bucket; summed within the task in bounded memory."""
    words: Counter = Counter()

    def flush():
        key = np.fromiter(map(word_hash, words), np.uint64, len(words))
        key, n = _sums(key, np.fromiter(words.values(), np.int64, len(words)))
        words.clear()
        cut = np.searchsorted(word_bucket(key), np.arange(WORD_BUCKETS + 1, dtype=np.uint64))
        some = [b for b in range(WORD_BUCKETS) if cut[b] < cut[b + 1]]
        for at in range(0, len(some), 64):
            part = some[at : at + 64]
            yield _batch(_WORDS, bucket=part, data=[_pack(key[cut[b] : cut[b + 1]], n[cut[b] : cut[b + 1]]) for b in part])

    for b in batches:
        for texts in small_lists(b.column(0).to_pylist(), CHUNK):
            for t in texts:
                words.update(words_of(t))
            words[END] += len(texts)
            if len(words) > 500_000:
                yield from flush()
    if words:
        yield from flush()


def _merge_words(batches):
    """The vocabulary of each bucket, sorted, from rows sorted by bucket: ``n`` words, ``total`` tokens."""
    own, key, n = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        nonlocal key, n
        key, n = _sums(np.concatenate([key, *[k for k, _ in held]]), np.concatenate([n, *[x for _, x in held]]))
        held.clear()

    for b in batches:
        for bucket, data in zip(b.column(0).to_pylist(), b.column(3)):
            if bucket != own and own is not None:
                merged()
                yield _batch(_WORDS, bucket=[own], n=[len(key)], total=[int(n.sum())], data=[_pack(key, n)])
                key, n = key[:0], n[:0]
            own = bucket
            held.append(tuple(_unpack(data.as_py(), "<u8", "<i8")))
            if sum(len(k) for k, _ in held) > 4_000_000:
                merged()
    if own is not None:
        merged()
        yield _batch(_WORDS, bucket=[own], n=[len(key)], total=[int(n.sum())], data=[_pack(key, n)])


# contexts


class Words:
    """What tasks share: frequent words by hash, their counts and ranks, and the distribution of single words."""

    def __init__(self, key: np.ndarray, n: np.ndarray, n_all: int, v_all: int):
        self.key, self.n, self.n_all, self.v_all = key, n, n_all, v_all
        self.z = float(n_all + v_all + 1)
        order = np.argsort(-n, kind="stable")
        self.rank = np.empty(len(n), np.uint32)
        self.rank[order] = np.arange(len(n), dtype=np.uint32)
        #: By rank.
        self.p = (n[order] + 1.0) / self.z
        #: Of each other word, known or not: an even share of what is left.
        self.rare = max(1.0 - float(self.p.sum()), 1.0 / self.z) / (v_all - len(key) + 1)
        self.splits = -(-n // max(1, BUCKET // 2))  # states or classes of a one-word context
        #: Words that are split, how often they precede a word in training rows, and their classes by hash.
        self.split, self.split_n = key[self.splits > 1], n[self.splits > 1]
        of = np.repeat(np.arange(len(self.split)), self.splits[self.splits > 1])
        cls = np.concatenate([np.arange(k) for k in self.splits[self.splits > 1]]) if len(of) else of
        c = mixed(self.split[of], cls.astype(np.uint64)) & _LOW40
        self.class_key, self.class_of = np.sort(c), of[np.argsort(c)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes, and whether they are there."""
        return _find(self.key, h)

    def ids(self, h: np.ndarray, place: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Ranks of frequent words; 40 bits of the hash of others, marked."""
        other = (h & _LOW40) | _OTHER
        return np.where(known, self.rank[place].astype(np.uint64), other) if len(self.key) else other

    def split_of(self, c1: np.ndarray) -> np.ndarray:
        """The split word whose class a context is, or -1."""
        at, there = _find(self.class_key, c1)
        return np.where(there, self.class_of[at], -1) if len(self.class_key) else at - 1


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


class _Lexicon:
    """Hashes and places of words, of which a worker remembers some."""

    def __init__(self, common: Words):
        self.common, self.ids = common, {}
        self.h, self.at, self.there = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def look(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and places of all words, and whether they are frequent, first learning those that are new."""
        ids = self.ids
        flat = [w for ws in split for w in ws]
        i = np.fromiter(map(ids.get, flat, repeat(-1)), np.int64, len(flat))
        missed = np.flatnonzero(i < 0)
        if len(missed):
            words = [flat[j] for j in missed.tolist()]
            new = list(dict.fromkeys(words))
            if ids and len(ids) + len(new) > CACHE_WORDS:
                ids.clear()
                self.h, self.at, self.there = self.h[:0], self.at[:0], self.there[:0]
                return self.look(split)
            h = np.fromiter(map(word_hash, new), np.uint64, len(new))
            a, t = self.common.find(h)
            ids.update(zip(new, range(len(ids), len(ids) + len(new))))
            self.h, self.at, self.there = np.concatenate([self.h, h]), np.concatenate([self.at, a]), np.concatenate([self.there, t])
            i[missed] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        return self.h[i], self.at[i], self.there[i]


def _contexts(common: Words, h: np.ndarray, place: np.ndarray, known: np.ndarray, size: np.ndarray, names: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its place in its document, the word before it, and the class of that word."""
    end = word_hash(END)
    inside = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    before = [_shift(h, inside, k, _U(end)) for k in (1, 2)]
    splits = np.where(known, common.splits[place], 1) if len(common.n) else np.ones(len(h), np.int64)
    a, t = common.find(np.array([end], np.uint64))
    splits = _shift(splits, inside, 1, common.splits[a[0]] if t[0] else 1)  # at starts of documents the end's
    name = np.repeat(np.array([d if d is not None else -1 for d in names], np.int64).view(np.uint64), size)
    of = np.where(inside >= 1, before[1] if DEPTH > 1 else name, name)
    cls = np.where(splits > 1, mixed(of, np.zeros(len(of), np.uint64)) % np.maximum(splits, 1).astype(np.uint64), _U(0))
    return inside, before[0], mixed(before[0], cls) & _LOW40


def _shift(x: np.ndarray, inside: np.ndarray, k: int, start) -> np.ndarray:
    """What lies ``k`` tokens before in the same document."""
    return np.where(inside >= k, np.concatenate([x[:k], x[:-k]]) if len(x) > k else x, start)


@dataclass
class Split:
    """Split words: their distinct next words, their occurrences before a word, and whether they are retained."""

    kinds: np.ndarray
    total: np.ndarray
    keep: np.ndarray


def score_bucket(context: list[np.ndarray], w: np.ndarray, p0: np.ndarray, train: np.ndarray, split: Split | None = None, of: np.ndarray | None = None, n_split: np.ndarray | None = None, start: np.ndarray | None = None, probe: bool = False):
    """log10 probability of each occurrence in a bucket that holds all occurrences of its contexts.

    ``context[k]`` tells contexts of ``k + 1`` words apart, ``w`` next words; ``p0`` are their
    probabilities without a context; ``train`` marks the occurrences that are learnt from.

    With ``split``, one-word contexts ``of`` 0 or more are those words, of whose occurrences others lie elsewhere:
    they were followed by ``w`` ``n_split`` times in all.  ``start`` marks occurrences with a context of one word only.
    ``probe`` returns instead the split words here, the gain from their occurrences and whether a longer context needs them.
    """
    p, levels = p0, []
    weight = train.astype(float)
    for k, ctx in enumerate(context):
        own, inv = np.unique(ctx, return_inverse=True)
        pair, back = np.unique(mixed(ctx, w), return_inverse=True)
        seen = np.bincount(back, weight, len(pair))
        state = np.empty(len(pair), np.int64)
        state[back] = inv
        kinds = np.bincount(state, seen > 0, len(own))
        total = np.bincount(inv, weight, len(own))
        n, u, t = seen[back], kinds[inv], total[inv]
        if split is not None and k == 0 and len(split.kinds):
            n, u, t = np.where(of >= 0, n_split, n), np.where(of >= 0, split.kinds[of], u), np.where(of >= 0, split.total[of], t)
        q = np.where(t > 0, (n + u * p) / np.maximum(t + u, 1.0), p)
        if k and start is not None:
            q = np.where(start, p, q)
        gain = np.bincount(inv, weight * np.log(q / p), len(own))
        keep = (gain >= DIVERGENCE) & (total > 0)
        if split is not None and k == 0:
            word, part = np.empty(len(own), np.int64), gain
            word[inv] = of
            keep[word >= 0] = split.keep[word[word >= 0]] & (not probe)
        levels.append([inv.astype(np.int32), *(x.astype(np.float32) for x in (n, u, t + u)), keep])
        p = q
    for k in range(len(levels) - 1, 0, -1):  # the suffixes of what is kept are kept
        inv, keep = levels[k][0], levels[k][4]
        levels[k - 1][4][levels[k - 1][0][keep[inv]]] = True
    if probe:
        return word[word >= 0], part[word >= 0], levels[0][4][word >= 0]
    p = p0
    for inv, n, u, d, keep in levels:
        p = np.where(keep[inv], (n + u * p) / np.maximum(d, 1.0), p)
    return np.log10(p)


_ROWS = "bucket int, kind int, origin long, doc int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, data binary"
_DOC, _CONTEXT, _RARE, _VOCABULARY, _SUMS, _COUNTS, _PAIRS, _ASK_PAIRS, _ASK_WORDS = range(9)
_ASKED = "bucket int, kind int, data binary"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, held: int = 2, whole: bool = False) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from rows whose ``crc32(doc_id as text) mod 7`` is not 2, all of them and whole.
    ``base_score`` is the add-one unigram score of the contract, exact over the whole vocabulary.
    With ``whole`` every one-word state has the counts of all its occurrences, every word without a context the share
    ``(c + 1) / (N + V + 1)``, and the start of a document is one state; else a frequent last word has a state for each class
    of preceding words, and rare words have an even share.
    Words are told apart by a 64-bit hash; in contexts frequent ones by rank and others by 40 bits of it.  Sums of scores travel as 32-bit numbers.  Null texts count as empty (the end token only), a null doc_id as the empty string;
    repeated rows are learnt and scored as often as they come; further columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    rest = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % mod
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (rest == held).alias("held_out"))
    counted = src.where("not held_out").select("text").mapInArrow(_count_words, _WORDS)
    vocabulary = staged(counted.repartition(WORD_BUCKETS, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge_words, _WORDS), "vocabulary")
    n_all, v_all = (x or 0 for x in vocabulary.agg(F.sum("total"), F.sum("n")).head())
    least = max(2, n_all * WORD_SHARE)

    def frequent(batches):
        for b in batches:
            for data in b.column(0):
                key, n = _unpack(data.as_py(), "<u8", "<i8")
                big = n >= least
                yield _batch("key long, n long", key=key[big].view(np.int64), n=n[big])

    got = vocabulary.select("data").mapInArrow(frequent, "key long, n long").toArrow()  # 2^22 rows at most
    key = got.column(0).to_numpy().view(np.uint64)
    o = np.argsort(key)
    shared = spark.sparkContext.broadcast(Words(key[o], got.column(1).to_numpy()[o], n_all, v_all))
    del got, key, o
    buckets = max(1, -(-n_all * mod // (max(1, mod - 1) * BUCKET)))
    bounds = (np.arange(buckets + 1, dtype=np.float64) * (2.0**40 / buckets)).astype(np.uint64)

    def send(batches):
        common = shared.value
        part = TaskContext.get().partitionId() << 40
        lexicon = _Lexicon(common)
        group = 0

        def packed(held_docs: list[tuple], h: np.ndarray, place: np.ndarray, known: np.ndarray):
            """Rows of the documents held: one each, and their occurrences by bucket."""
            nonlocal group
            origin = part | group
            group += 1
            size = np.array([d[2] for d in held_docs])
            first = np.cumsum(size) - size
            doc = np.repeat(np.arange(len(size)), size)
            train = np.repeat(np.array([not d[1] for d in held_docs]), size)
            value = np.log10(common.n[place] + 1.0) if len(common.n) else np.zeros(len(h))
            base = np.add.reduceat(np.where(known, value, 0.0), first)
            n_known = np.add.reduceat(known, first, dtype=np.int64)
            n = len(size)
            yield _batch(_ROWS, bucket=-1 - (np.arange(n) + 7919 * group + (part >> 40)) % 4096, kind=np.full(n, _DOC), origin=np.full(n, origin), doc=np.arange(n), doc_id=[d[0] for d in held_docs], held_out=[d[1] for d in held_docs], n_tokens=size, n_known=n_known, base=base)
            inside, _, c1 = _contexts(common, h, place, known, size, [d[0] for d in held_docs])
            own = common.ids(h, place, known)
            end = np.array([word_hash(END)], np.uint64)
            start = common.ids(end, *common.find(end))[0]
            more = [_shift(own, inside, k, start) for k in range(2, DEPTH + 1)]
            o = np.argsort((c1 << _U(24)) | np.minimum(more[0], _ESCAPE) if more else c1)
            c1, tag = c1[o], (doc[o] * 2 + train[o]).astype("<u2")
            more, w = [m[o] for m in more], own[o]
            cut = np.searchsorted(c1, bounds)
            cut[-1] = len(c1)
            some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            for s in range(0, len(some), 16):
                data = []
                for b in some[s : s + 16]:
                    i, j = cut[b], cut[b + 1]
                    starts = np.flatnonzero(np.r_[True, c1[i + 1 : j] != c1[i : j - 1]])
                    words = [_words(x[i:j], _rising if k == 1 else _planes) for k, x in enumerate((w, *more))]
                    data.append(_pack(_rising(c1[i:j][starts]), np.diff(np.r_[starts, j - i]).astype("<u4"), tag[i:j], *[x for pair in words for x in pair]))
                b = some[s : s + 16]
                yield _batch(_ROWS, bucket=b, kind=np.full(len(b), _CONTEXT), origin=np.full(len(b), origin), data=data)
            rare, of_doc = h[~known], doc[~known].astype("<u2")
            o = np.argsort(rare)
            rare, of_doc = rare[o], of_doc[o]
            cut = np.searchsorted(word_bucket(rare), np.arange(WORD_BUCKETS + 1, dtype=np.uint64))
            b = [x for x in range(WORD_BUCKETS) if cut[x] < cut[x + 1]]
            if b:
                yield _batch(_ROWS, bucket=b, kind=np.full(len(b), _RARE), origin=np.full(len(b), origin), data=[_pack(rare[cut[x] : cut[x + 1]], of_doc[cut[x] : cut[x + 1]]) for x in b])

        held_docs: list[tuple] = []
        parts: list[tuple] = []
        tokens = 0

        def flush():
            nonlocal held_docs, parts, tokens
            out = packed(held_docs, *[np.concatenate(c) for c in zip(*parts)])
            held_docs, parts, tokens = [], [], 0
            yield from out

        for b in batches:
            i = 0
            who, out = b.column(0).to_pylist(), b.column(2).to_pylist()
            for texts in small_lists(b.column(1).to_pylist(), CHUNK):
                split = [[*words_of(t), END] for t in texts]
                looked = lexicon.look(split)
                if held_docs and (tokens + len(looked[0]) > PACK_TOKENS or len(held_docs) + len(texts) > PACK_DOCS):
                    yield from flush()
                for s in range(0, len(texts), PACK_DOCS):
                    size = [len(ws) for ws in split[s : s + PACK_DOCS]]
                    own, looked = [x[: sum(size)] for x in looked], [x[sum(size) :] for x in looked]
                    if held_docs and len(held_docs) + len(size) > PACK_DOCS:
                        yield from flush()
                    held_docs += zip(who[i : i + len(size)], out[i : i + len(size)], size)
                    parts.append(own)
                    tokens += len(own[0])
                    i += len(size)
        if held_docs:
            yield from flush()

    def occurrences(common, split, blobs, counts):
        """The sizes and tags of blobs, and what ``score_bucket`` needs of them."""
        got = [_unpack(data, "u1", "<u4", "<u2", *["u1"] * (2 * DEPTH)) for _, data in blobs]
        ctx = np.concatenate([np.repeat(_from_rising(g[0]), g[1]) for g in got])
        tag, w = np.concatenate([g[2] for g in got]), _from_words([g[3:5] for g in got], _from_planes)
        context = [ctx]
        for k in range(1, DEPTH):
            context.append(mixed(context[-1], _from_words([g[3 + 2 * k : 5 + 2 * k] for g in got], _from_rising if k == 1 else _from_planes)))
        size, train = [len(g[2]) for g in got], (tag & 1) == 1
        del got
        p0 = np.full(len(w), common.rare)
        p0[w < _RANKS] = common.p[w[w < _RANKS]]
        if split is None:
            return size, tag, context, w, p0, train
        key, n = (np.concatenate(c) for c in zip(*[(_from_rising(k, 8), n) for k, n in (_unpack(c, "u1", "<i8") for c in counts)])) if counts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        key, at = np.unique(key, return_index=True)
        n = n[at]

        def count(x):
            at, there = _find(key, x)
            return np.where(there, n[at], 0) if len(key) else at

        p0[w >= _RANKS] = (count((_RARE_WORDS << _U(41)) | w[w >= _RANKS]) + 1.0) / common.z
        of = common.split_of(ctx)
        n_split = np.zeros(len(w))
        n_split[of >= 0] = count((of[of >= 0].astype(np.uint64) << _U(41)) | w[of >= 0])
        end = np.array([word_hash(END)], np.uint64)
        at, there = _find(common.split, end)
        start = of == at[0] if there[0] else ctx == (mixed(end, np.zeros(1, np.uint64)) & _LOW40)[0]
        return size, tag, context, w, p0, train, split, of, n_split, start

    def work(batches):
        common = shared.value
        own = None
        contexts: list[tuple[int, bytes]] = []
        counts: list[bytes] = []
        rare: list[tuple[int, bytes]] = []
        vocabulary: list[bytes] = []

        def close():
            sums: dict[int, list] = {}
            if contexts:
                for origin, doc, value in in_contexts(contexts, counts):
                    sums.setdefault(origin, []).append((doc, value.astype("<f4"), np.zeros(len(doc)), np.zeros(len(doc), "<u4")))
            if rare:
                for origin, doc, more, known in in_words(rare, vocabulary):
                    sums.setdefault(origin, []).append((doc, np.zeros(len(doc), "<f4"), more, known))
            names = list(sums)
            for s in range(0, len(names), 64):
                part = names[s : s + 64]
                yield _batch(_ROWS, kind=np.full(len(part), _SUMS), origin=part, data=[_pack(*[np.concatenate(c) for c in zip(*sums[x])]) for x in part])
            contexts.clear(), counts.clear(), rare.clear(), vocabulary.clear()

        def in_contexts(blobs, counts):
            size, tag, *parts = occurrences(common, split and split.value, blobs, counts)
            value = score_bucket(*parts)
            at = 0
            for (origin, _), n in zip(blobs, size):
                doc = tag[at : at + n] >> 1
                own_doc = np.unique(doc)
                yield origin, own_doc.astype("<u2"), np.bincount(doc, value[at : at + n])[own_doc]
                at += n

        def in_words(blobs, vocabulary):
            key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if vocabulary:
                key, n = (np.concatenate(c) for c in zip(*[_unpack(v, "<u8", "<i8") for v in vocabulary]))
            for origin, data in blobs:
                h, doc = _unpack(data, "<u8", "<u2")
                seen = np.zeros(len(h), np.int64)
                if len(key):
                    at = np.minimum(np.searchsorted(key, h), len(key) - 1)
                    seen = np.where(key[at] == h, n[at], 0)
                own_doc = np.unique(doc)
                yield origin, own_doc, np.bincount(doc, np.log10(seen + 1.0))[own_doc], np.bincount(doc, seen > 0)[own_doc].astype("<u4")

        for b in batches:
            bucket, kind = b.column(0).to_pylist(), b.column(1).to_pylist()
            simple = pa.array([k == _DOC for k in kind])
            if simple.true_count:
                yield b.filter(simple)
            for i, k in enumerate(kind):
                if k == _DOC:
                    continue
                if bucket[i] != own and own is not None:
                    yield from close()
                own = bucket[i]
                data = b.column(9)[i].as_py()
                if k == _VOCABULARY:
                    vocabulary.append(data)
                elif k == _COUNTS:
                    counts.append(data)
                else:
                    (contexts if k == _CONTEXT else rare).append((b.column(2)[i].as_py(), data))
        if own is not None:
            yield from close()

    z = float(np.log10(n_all + 1.0 * (v_all + 1))) if n_all else 0.0

    def gather(batches):
        """Documents with their sums, from rows sorted by origin and kind."""
        own, rows, sums = None, [], None

        def close():
            doc = pa.Table.from_batches(rows)
            order = np.argsort(doc.column("doc").to_numpy())
            doc = doc.take(pa.array(order))
            score, more, seen = sums[:, : doc.num_rows]
            base = doc.column("base").to_numpy() + more - doc.column("n_tokens").to_numpy() * z
            known = doc.column("n_known").to_numpy() + seen.astype(np.int64)
            out = [doc.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(known), pa.array(base), pa.array(score)], [x.split()[0] for x in _OUT.split(", ")])

        for b in batches:
            origin, kind = b.column(2).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, origin[1:] != origin[:-1]]) if len(origin) else []
            for i, j in zip(cuts, [*cuts[1:], len(origin)]):
                if origin[i] != own:
                    if own is not None:
                        yield from close()
                    own, rows, sums = origin[i], [], np.zeros((3, PACK_DOCS))
                part = b.slice(i, j - i)
                mine = part.filter(pa.array(kind[i:j] == _DOC))
                if mine.num_rows:
                    rows.append(mine)
                for data in part.filter(pa.array(kind[i:j] == _SUMS)).column(9):
                    doc, score, more, known = _unpack(data.as_py(), "<u2", "<f4", "<f8", "<u4")
                    for row, value in zip(sums, (score, more, known)):
                        row += np.bincount(doc, value, PACK_DOCS)
        if own is not None:
            yield from close()

    def padded(rows):
        return rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in _ROWS.split(", "))])

    sent = src.mapInArrow(send, _ROWS)
    kept = vocabulary.select("bucket", F.lit(_VOCABULARY).alias("kind"), "data")
    rows, split = sent.unionByName(padded(kept)), None
    if whole:
        counts = _counts(src, kept, shared, bounds)
        split = _split(spark, counts, shared, least)
        rows = sent.unionByName(padded(kept.unionByName(counts.where(F.col("kind") == _COUNTS))))
        doubtful = np.flatnonzero(~split.keep)
        if len(doubtful):
            split = _probed(spark, rows, split, shared, bounds, doubtful, occurrences)
        split = spark.sparkContext.broadcast(split)
    dealt = rows.repartition(max(buckets, WORD_BUCKETS), "bucket").sortWithinPartitions("bucket", "kind")
    back = dealt.mapInArrow(work, _ROWS).repartition("origin").sortWithinPartitions("origin", "kind").mapInArrow(gather, _OUT)
    return back.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


# counts that do not lie in one bucket of contexts


def _counts(src: DataFrame, vocabulary: DataFrame, shared, bounds: np.ndarray) -> DataFrame:
    """For each bucket of contexts how often its split words precede their next words in all training rows, and its rare words occur."""
    buckets = len(bounds) - 1
    pair_buckets = max(WORD_BUCKETS, buckets // 8)

    def pair_bucket(key):
        return ((mixed(key, np.zeros(len(key), np.uint64)) >> _U(32)) * _U(pair_buckets)) >> _U(32)

    def rows(kind, bucket, n_buckets, *columns):
        """Rows of columns sorted by bucket, each with what packs it."""
        cut = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=bucket.dtype))
        some = [b for b in range(n_buckets) if cut[b] < cut[b + 1]]
        for s in range(0, len(some), 64):
            part = some[s : s + 64]
            yield _batch(_ASKED, bucket=part, kind=np.full(len(part), kind), data=[_pack(*[f(c[cut[b] : cut[b + 1]]) for f, c in columns]) for b in part])

    def rising(x):
        return _rising(x, 8)

    def four(x):
        return _planes(x.astype(np.uint64), 4)

    def ask(batches):
        common = shared.value
        lexicon = _Lexicon(common)
        pairs, words = [], []

        def merged(held):
            return [_pair_sums(*(np.concatenate(c) for c in zip(*held)))] if held else []

        def flush():
            for key, b, n in merged(pairs):
                to = pair_bucket(key)
                o = np.argsort(to, kind="stable")
                yield from rows(_ASK_PAIRS, to[o], pair_buckets, (rising, key[o]), (four, b[o]), (four, n[o]))
            for h, b, _ in merged(words):
                yield from rows(_ASK_WORDS, word_bucket(h), WORD_BUCKETS, (rising, h), (four, b))
            pairs.clear(), words.clear()

        asked = 0
        for batch in batches:
            i = 0
            who, out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for texts in small_lists(batch.column(1).to_pylist(), CHUNK):
                split = [[*words_of(t), END] for t in texts]
                h, place, known = lexicon.look(split)
                size = np.array([len(ws) for ws in split])
                _, last, c1 = _contexts(common, h, place, known, size, who[i : i + len(texts)])
                train = np.repeat(np.array([not x for x in out[i : i + len(texts)]], np.int64), size)
                i += len(texts)
                of, there = _find(common.split, last)
                b, some = np.zeros(len(h), np.int64), there | ~known
                b[some] = np.minimum(np.searchsorted(bounds, c1[some], side="right") - 1, buckets - 1)
                key = (of[there].astype(np.uint64) << _U(41)) | common.ids(h[there], place[there], known[there])
                pairs.append((key, b[there], train[there]))
                words.append((h[~known], b[~known], train[~known]))
                asked += len(pairs[-1][0]) + len(words[-1][0])
                if asked > ASKS:
                    pairs[:], words[:] = merged(pairs), merged(words)
                    asked = len(pairs[0][0]) + len(words[0][0])
                    if asked > ASKS // 2:
                        yield from flush()
                        asked = 0
        yield from flush()

    def told(key, b, n):
        o = np.lexsort((key, b))
        yield from rows(_COUNTS, b[o], buckets, (rising, key[o]), (lambda x: x.astype("<i8"), n[o]))

    def answer(batches):
        own, key, n = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pairs, words, known = [], [], []

        def merge():
            pairs[:] = [_pair_sums(*(np.concatenate(c) for c in zip(*pairs)))]

        def tell():
            h, b, _ = _pair_sums(*(np.concatenate(c) for c in zip(*words)), np.zeros(sum(len(x) for x, _ in words), np.int64))
            at, there = _find(key, h)
            words.clear()
            yield from told((_RARE_WORDS << _U(41)) | _OTHER | (h & _LOW40), b, np.where(there, n[at], 0) if len(key) else at)

        def close():
            nonlocal key, n
            if pairs:
                merge()
                pair, b, m = pairs.pop()
                at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                total = np.add.reduceat(m, at)
                some = total > 0
                yield _batch(_ASKED, bucket=[-1], kind=[_PAIRS], data=[_pack(_rising(pair[at][some], 8), total[some].astype("<i8"))])
                yield from told(pair, b, np.repeat(total, np.diff(np.r_[at, len(pair)])))
            if words:
                yield from tell()
            key, n = key[:0], n[:0]

        for batch in batches:
            for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != own and own is not None:
                    yield from close()
                own, data = bucket, data.as_py()
                if kind == _VOCABULARY:
                    key, n = _unpack(data, "<u8", "<i8")
                elif kind == _ASK_PAIRS:
                    k, b, m = _unpack(data, "u1", "u1", "u1")
                    pairs.append((_from_rising(k, 8), _from_planes(b, 4).astype(np.int64), _from_planes(m, 4).astype(np.int64)))
                    if len(pairs) > 1 and sum(len(x) for x, _, _ in pairs[1:]) > ASKS:
                        merge()
                else:
                    h, b = _unpack(data, "u1", "u1")
                    words.append((_from_rising(h, 8), _from_planes(b, 4).astype(np.int64)))
                    if sum(len(x) for x, _ in words) > ASKS:
                        yield from tell()
        if own is not None:
            yield from close()

    asks = src.mapInArrow(ask, _ASKED).unionByName(vocabulary)
    return staged(asks.repartition(pair_buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, _ASKED), "counts")


def _split(spark, counts: DataFrame, shared, least: float) -> Split:
    """What is known of split words from their pairs; retained are those that gain enough however frequent rare words are."""
    words = shared.value
    split = Split(np.zeros(len(words.split)), words.split_n.astype(float), np.zeros(len(words.split), bool))
    if not len(words.split):
        return split
    pairs = counts.where(F.col("kind") == _PAIRS).select("data")

    def per_word(f):
        def sums(batches):
            for b in batches:
                for data in b.column(0):
                    key, n = _unpack(data.as_py(), "u1", "<i8")
                    key = _from_rising(key, 8)
                    of = (key >> _U(41)).astype(np.int64)
                    value = np.bincount(of, f(of, key & _U((1 << 41) - 1), n))
                    some = np.unique(of)
                    yield _batch("word int, value double", word=some, value=value[some])

        out = np.zeros(len(split.total))
        for word, value in pairs.mapInArrow(sums, "word int, value double").groupBy("word").agg(F.sum("value")).collect():
            out[word] = value
        return out

    split.kinds = per_word(lambda of, w, n: np.ones(len(n)))

    def gain(of, w, n):
        common = shared.value
        p = np.full(len(w), min(1.0, (least + 1.0) / common.z))
        p[w < _RANKS] = common.p[w[w < _RANKS]]
        u, t = split.kinds[of], split.total[of]
        return n * np.log((n + u * p) / ((t + u) * p))

    split.keep = per_word(gain) >= DIVERGENCE
    return split


def _probed(spark, rows: DataFrame, split: Split, shared, bounds: np.ndarray, doubtful: np.ndarray, occurrences) -> Split:
    """The same with words retained whose gain, summed over the buckets of their classes, is enough or that longer contexts need."""
    words = shared.value
    c1 = words.class_key[np.isin(words.class_of, doubtful)]
    buckets = np.unique(np.minimum(np.searchsorted(bounds, c1, side="right") - 1, len(bounds) - 2)).tolist()
    known = spark.sparkContext.broadcast(split)

    def probe(batches):
        own, contexts, counts = None, [], []

        def close():
            if contexts:
                _, _, *parts = occurrences(shared.value, known.value, contexts, counts)
                word, gain, needed = score_bucket(*parts, probe=True)
                yield _batch("word int, gain double, needed boolean", word=word, gain=gain, needed=needed)
            contexts.clear(), counts.clear()

        for b in batches:
            for bucket, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if bucket != own and own is not None:
                    yield from close()
                own = bucket
                contexts.append((0, data.as_py())) if kind == _CONTEXT else counts.append(data.as_py())
        if own is not None:
            yield from close()

    some = rows.where(F.col("kind").isin(_CONTEXT, _COUNTS) & F.col("bucket").isin(buckets)).select("bucket", "kind", "data")
    dealt = some.repartition(len(buckets), "bucket").sortWithinPartitions("bucket", "kind")
    keep = split.keep.copy()
    for word, gain, needed in dealt.mapInArrow(probe, "word int, gain double, needed boolean").groupBy("word").agg(F.sum("gain"), F.max("needed")).collect():
        keep[word] |= needed or gain >= DIVERGENCE
    return Split(split.kinds, split.total, keep)
