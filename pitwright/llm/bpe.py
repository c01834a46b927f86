"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by a pattern. Each distinct pre-token is resolved on two tiers: a minimal perfect hash
over the vocabulary finds it whole, with one comparison of the stored bytes; what is no vocabulary entry is merged by
a heap of candidate pairs over a linked list of its bytes. Equal pieces of a worker's texts are resolved once while
they stay in a bounded memo.

Ids are packed as little-endian unsigned 32-bit integers in a binary column. A null text is an empty text, with no
ids. Texts are encoded whole, however long. Input columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts
from .mph import MinimalPerfectHash

#: Entries of a worker's memo, and characters of its longest key; a full memo is emptied.
MEMO_ENTRIES = 400_000
MEMO_KEY = 64

_RUN = re.compile(r"\s ")
_CHUNK = regex.compile(r"\s*\S+|\s+")


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: lines of a base64 token and its id. The path is opened by Spark, or else locally."""
    try:
        with open(path, "rb") as f:
            lines = f.read().splitlines()
    except OSError:
        lines = [bytes(r[0]) for r in spark.read.text(path).selectExpr("cast(value as binary)").collect()]
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def heap_merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids after always merging the adjacent pair of lowest rank, the leftmost of equals.

    Parts are linked by their first bytes; the heap holds rank and first byte of each pair that can merge, in one
    integer. An entry is out of date if the pair that starts there now has another rank.
    """
    n = len(token)
    get = ranks.get
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank = [get(token[i : i + 2], -1) for i in range(n)]
    rank[-1:] = [-1] * bool(n)
    shift = n.bit_length()
    low = (1 << shift) - 1
    heap = [r << shift | i for i, r in enumerate(rank) if r >= 0]
    heapify(heap)
    while heap:
        x = heappop(heap)
        i = x & low
        if rank[i] != x >> shift:
            continue
        mid = after[i]
        end = after[i] = after[mid]
        rank[mid] = rank[i] = -1
        if end < n:
            before[end] = i
            r = rank[i] = get(token[i : after[end]], -1)
            if r >= 0:
                heappush(heap, r << shift | i)
        if i:
            p = before[i]
            r = rank[p] = get(token[p:end], -1)
            if r >= 0:
                heappush(heap, r << shift | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        keys = list(ranks)
        self.mph = MinimalPerfectHash.build(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64))
        numbers = self.mph.lookup(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)).tolist()
        self.key_of: list[bytes] = [b""] * len(keys)
        self.id_of: list[int] = [0] * len(keys)
        for k, i in zip(keys, numbers):
            self.key_of[i], self.id_of[i] = k, ranks[k]
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for k, i in ranks.items():
            self.bytes_of[i] = k
        self.pieces: dict[str, bytes] = {}  #: packed ids of a space and the piece
        self.alone: dict[str, bytes] = {}  #: packed ids of the piece as it stands
        self._long: list = []
        self.tokens: dict[bytes, bytes] = {}  #: packed ids of a pre-token

    def resolve(self, tokens: list[bytes]) -> list[bytes]:
        """Packed ids of whole pre-tokens: by the perfect hash, or else by the heap."""
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))
        out = []
        for token, i in zip(tokens, self.mph.lookup(hashes).tolist()):
            ids = [self.id_of[i]] if i >= 0 and self.key_of[i] == token else heap_merge(token, self.ranks)
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def _fill(self, memo: dict[str, bytes], pieces: list[str], before: str) -> None:
        """Adds the pieces to the memo, each with `before` in front of it."""
        cut = [[t.encode("utf-8", "surrogatepass") for t in self.pattern.findall(before + p)] for p in pieces]
        known = self.tokens
        new = list({t for tokens in cut for t in tokens}.difference(known))
        known.update(zip(new, self.resolve(new)))
        memo.update((p, b"".join([known[t] for t in tokens])) for p, tokens in zip(pieces, cut))

    def release(self) -> None:
        """Empties all memos; a worker that waits for its next task holds none."""
        self.pieces, self.alone, self.tokens, self._long = {}, {}, {}, []

    def _trim(self) -> None:
        """Empties memos that are full, and drops long keys."""
        for memo, most in ((self.pieces, MEMO_ENTRIES), (self.alone, MEMO_ENTRIES // 8), (self.tokens, 2 * MEMO_ENTRIES)):
            if len(memo) > most:
                memo.clear()
            for k in [k for k in self._long if k in memo]:
                del memo[k]
        self._long = []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text.

        No pre-token runs from a non-space into the space after it, so a text may be cut there. The usual cut is at
        single spaces, whose pieces are known with the space before them; a text with other runs of spaces before a
        space is cut by _CHUNK.
        """
        self._trim()
        cut = []
        for text in texts:
            if _RUN.search(text) or text[:1] == " ":
                cut.append((_CHUNK.findall(text), []))
            else:
                first, *rest = text.split(" ")
                cut.append(([first], rest))
        for memo, before, own in ((self.alone, "", 0), (self.pieces, " ", 1)):
            new = list(set().union(*[c[own] for c in cut]).difference(memo))
            self._long += [p for p in new if len(p) > MEMO_KEY]
            self._fill(memo, new, before)
        self._long += [t for t in self.tokens if len(t) > MEMO_KEY] if self._long else []
        alone, spaced = self.alone.__getitem__, self.pieces.__getitem__
        return [b"".join([*map(alone, a), *map(spaced, b)]) for a, b in cut]

    def decode(self, packed: Iterable[bytes]) -> list[bytes]:
        table = self.bytes_of.__getitem__
        return [b"".join(map(table, np.frombuffer(p, "<u4").tolist())) for p in packed]


_CODECS: dict[str, Codec] = {}


def _codec(vocabulary) -> Callable[[], Codec]:
    """vocabulary: a broadcast (ranks, pattern), bounded by the vocabulary. A worker builds the codec once."""

    def get() -> Codec:
        if vocabulary.id not in _CODECS:
            _CODECS.clear()
            _CODECS[vocabulary.id] = Codec(*vocabulary.value)
        return _CODECS[vocabulary.id]

    return get


class Tokenizer:
    """Encodes and decodes columns of a DataFrame."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        shared = spark.sparkContext.broadcast((read_ranks(spark, path), pattern))
        self._get = _codec(_Handle(shared, f"{path}\n{pattern}"))

    def encode(self, df: DataFrame, *, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
        """The columns keep (None: all) and the packed ids."""
        get = self._get
        return map_texts(df, lambda texts: [get().encode(texts)], [(ids_col, "binary")], text_col=text_col, keep=keep, after=lambda: get().release())

    def decode(self, df: DataFrame, *, ids_col: str = "ids", bytes_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
        """The columns keep (None: all) and the bytes of the ids; null ids count as none."""
        get = self._get
        plain = df.withColumn(ids_col, F.coalesce(F.col(ids_col), F.lit(b"")))
        return map_texts(plain, lambda packed: [get().decode(packed)], [(bytes_col, "binary")], text_col=ids_col, keep=keep)

    def encode_and_decode(self, df: DataFrame, *, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
        """encode() and decode() of its ids in one pass through Python."""
        get = self._get

        def kernel(texts: list[str]) -> list[list[bytes]]:
            packed = get().encode(texts)
            return [packed, get().decode(packed)]

        return map_texts(df, kernel, [(ids_col, "binary"), (bytes_col, "binary")], text_col=text_col, keep=keep, after=lambda: get().release())


class _Handle:
    """A broadcast and a name under which workers keep what they build from it."""

    def __init__(self, shared, name: str):
        self.shared, self.id = shared, name

    @property
    def value(self):
        return self.shared.value
