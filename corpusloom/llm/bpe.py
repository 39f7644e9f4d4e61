"""Byte-level BPE with the tokenizers library: rank files, encoding with offsets, and decoding.

A rank file becomes a ``tokenizers`` BPE model by mapping bytes to printable characters and listing
every pair of tokens whose concatenation is a token, in the order of that token's rank.

Texts are cut before each space that a non-space follows.  A match of the pattern never holds a
non-space character followed by a space, and of a run of white space before a non-space the last
space belongs to what follows; so each chunk is encoded as it would be inside its text, and frequent
chunks come from a bounded table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that a worker remembers, and the longest chunk remembered.
CACHE_CHUNKS, CACHE_CHARS = 300_000, 32

_ODD_SPACE = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def from_ranks(ranks: dict[bytes, int], pattern: str | None = None):
    """A ``tokenizers.Tokenizer`` that encodes as the rank file says."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    chars = byte_chars()
    text = {t: "".join([chars[b] for b in t]) for t in ranks}
    merges = [(text[t[:i]], text[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    out = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    if pattern:
        split = pre_tokenizers.Split(Regex(pattern), behavior="isolated")
        out.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    else:
        out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    out.decoder = decoders.ByteLevel()
    return out


@functools.lru_cache(maxsize=4)
def load(path: str):
    """``(tokenizer, token bytes by id)`` of a .tiktoken rank file or a tokenizers .json file."""
    if path.endswith(".tiktoken"):
        ranks = read_ranks(path)
        return from_ranks(ranks), {r: t for t, r in ranks.items()}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_chars())}
    return tok, {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in tok.get_vocab().items()}


def chunks(text: str) -> list[str]:
    """``text`` cut before each space that a non-space follows; joined they give the text."""
    parts = text.split(" ") if not _ODD_SPACE.search(text) else _CUT.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


class Encoder:
    """Encodes whole texts chunk by chunk; ids are kept as packed little-endian 32-bit numbers."""

    def __init__(self, path: str, fast: bool = False):
        """``fast``: encode whole texts with a rank file by tiktoken, which gives the same ids; added tokens are text here."""
        self.known: dict[str, bytes] = {}
        if fast:
            import public_tokenizers
            import tiktoken

            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
            self.packed = lambda texts: [enc.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for t in texts]
        else:
            tok = load(path)[0]
            batch = getattr(tok, "encode_batch_fast", tok.encode_batch)
            self.many = lambda texts: [e.ids for e in batch(texts, add_special_tokens=False)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        known, extra = self.known, {}
        cut = [chunks(t) for t in texts]
        missing = list({c for parts in cut for c in parts if c not in known})
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            for c, ids in zip(part, self.many(part)):
                to = known if len(known) < CACHE_CHUNKS and len(c) <= CACHE_CHARS else extra
                to[c] = np.array(ids, dtype="<u4").tobytes()
        if extra:
            return [b"".join([known[c] if c in known else extra[c] for c in parts]) for parts in cut]
        return [b"".join([known[c] for c in parts]) for parts in cut]


@functools.lru_cache(maxsize=4)
def encoder(path: str, fast: bool = False) -> Encoder:
    """One encoder for each worker process and file, so that its table outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, fast)


@functools.lru_cache(maxsize=4)
def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizers .json file, or of the one beside a .tiktoken rank file; none if there is no such file."""
    path = re.sub(r"\.tiktoken$", ".json", path)
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def packed_with_added(enc: Encoder, texts: list[str], added: dict[str, int]) -> list[bytes]:
    """``enc.packed``, but each literal of ``added`` is its own id, as the .json file has it by default."""
    if not added:
        return enc.packed(texts)
    literal = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    parts = [literal.split(t) if any(x in t for x in added) else [t] for t in texts]
    got = iter(enc.packed([p for ps in parts for p in ps[::2]]))
    return [b"".join([added[p].to_bytes(4, "little") if i % 2 else next(got) for i, p in enumerate(ps)]) for ps in parts]


def small_lists(texts: list[str | None], most: int = 4_000_000):
    """Runs of ``texts`` with about ``most`` characters each, so that memory does not follow the batch."""
    run, held = [], 0
    for t in texts:
        run.append(t or "")
        held += len(run[-1])
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """``(doc_id, ids array<int>, starts array<int>, ends array<int>)`` for every row.

    ``starts`` and ``ends`` are character offsets of each token in the text; tokens inside a
    character that was split share its offsets.  Null texts count as empty and give empty arrays;
    repeated rows are encoded again; further columns are ignored.
    """
    kind = "doc_id long, ids array<int>, starts array<int>, ends array<int>"

    def run(batches):
        tok = load(path)[0]
        for b in batches:
            at = 0
            for texts in small_lists(b.column(1).to_pylist(), 400_000):
                got = tok.encode_batch(texts, add_special_tokens=False)
                cols = [[e.ids for e in got], [[o[0] for o in e.offsets] if offsets else [] for e in got], [[o[1] for o in e.offsets] if offsets else [] for e in got]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *[pa.array(c, pa.list_(pa.int32())) for c in cols]], ["doc_id", "ids", "starts", "ends"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, kind)


def decode_bytes(ids, table: dict[int, bytes]) -> bytes:
    """The bytes of a run of ids; a character split over tokens comes together again."""
    return b"".join([table[i] for i in ids])


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of ``ids``; bytes that are no UTF-8, as where ids cut a character, give U+FFFD.

    Null ids count as none and give an empty text; an id outside the vocabulary raises KeyError.
    """

    def run(batches):
        table = load(path)[1]
        for b in batches:
            text = [decode_bytes(x or [], table).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("x")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null texts count as empty.  Repeated rows come back as often as they came in.
    """
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc, table = encoder(path), load(path)[1]
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for texts in small_lists(b.column(1).to_pylist()):
                for packed in enc.packed(texts):
                    ids = np.frombuffer(packed, "<u4").tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decode_bytes(ids, table)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, kind)
