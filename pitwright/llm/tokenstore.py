"""Raw token-id files with a minimal perfect hash index.

A store is a folder of shards, each the ids of a range of document keys in ascending order, and a manifest:

* shard-NNNNN.bin: the ids of its documents one after another, little-endian unsigned integers of 16 bits (32 where
  the vocabulary needs them);
* shard-NNNNN.idx: a minimal perfect hash of the shard's keys and, under each key's number, a 64-bit fingerprint of
  the key, where its ids start and how many there are;
* manifest.json: width of the ids, and for each shard its first and last key, documents, ids and the ids before it.

A key is found by one look at the manifest, one hash, one comparison of fingerprints and one read of its ids. Keys are
integers; null is a key too, the first. Rows of one key are told apart by their number among them (in the order of
the XXH64 of their texts); where they are many, they go on over several shards, and the manifest says how many rows of a
shard's first key lie in the shards before. Shards are written under a name of the attempt and then renamed, so a task that is run again replaces
its files by equal ones. A null text has only the end id.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, require_columns, shared_dir, slices
from .mph import MinimalPerfectHash, mix

MEMO_ENTRIES = 500_000
MEMO_KEY = 64
#: What a store gives back of a document, and the types.
COLUMNS = {"ids": "binary", "n_ids": "bigint", "ids_crc32": "bigint"}
#: Bytes that are read at once, and between two documents that are still read together.
READ = 4 << 20
GAP = 1 << 16
#: Words whose ids are those of their letters (Latin-1, so that composing changes nothing and lower case is one letter
#: for one), lower-cased, and then those of their last sign.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_BLANKS = "\t\n\v\f\r"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others in
    turn from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class WordEncoder:
    """Ids of texts as a tokenizer file of the tokenizers library gives them, adding no special tokens. Strings of the
    file's added tokens become those tokens, as in the library.

    Only for tokenizers that drop white space and take what stands between it by itself: each word is encoded once
    while it stays in a bounded memo.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {"": b""}
        self.letters: dict[str, bytes] = {}
        self.signs = {s: self._pack(self.tokenizer.encode(s, add_special_tokens=False).ids) for s in (".", ",")} | {"": b""}
        self._long: list[str] = []

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _letters(self, word: str) -> bytes:
        if (ids := self.letters.get(word)) is None:
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            ids = self._pack([t.id for t in self.tokenizer.model.tokenize(spelt)])
            if len(word) <= MEMO_KEY:
                self.letters[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > MEMO_ENTRIES:
            self.words = {"": b""}
        if len(self.letters) > MEMO_ENTRIES:
            self.letters = {}
        for w in self._long:
            self.words.pop(w, None)
        memo = self.words
        cut = []
        for t in texts:
            for blank in _BLANKS:
                if blank in t:
                    t = t.replace(blank, " ")
            cut.append(t.split(" "))
        new = set().union(*cut).difference(memo)
        self._long = [w for w in new if len(w) > MEMO_KEY]
        other = []
        for w in new:
            if m := _PLAIN.fullmatch(w):
                memo[w] = self._letters(m[1].lower()) + self.signs[m[2]]
            else:
                other.append(w)
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            memo[w] = self._pack(e.ids)
        return [b"".join(map(memo.__getitem__, words)) for words in cut]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _hashes(keys: np.ndarray, null: np.ndarray, number: np.ndarray, seed: int) -> np.ndarray:
    h = mix(np.where(null, 0, keys).astype(np.int64).view(np.uint64), seed)
    h = np.where(null, mix(np.full(len(keys), 0x5851F42D4C957F2D, np.uint64), seed + 1), h)
    return np.where(number == 0, h, mix(h ^ mix(number.astype(np.uint64), seed + 2), seed + 3))


def _occurrences(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Number of each row among those of its key; equal keys are neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64)
    first = np.r_[True, (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])]
    at = np.arange(len(keys))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null


def write_index(keys: np.ndarray, null: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    number = _occurrences(keys, null)
    seed = 0
    while True:
        hashes = _hashes(keys, null, number, seed)
        if len(np.unique(hashes)) == len(hashes):
            break
        seed += 10
    mph = MinimalPerfectHash.build(hashes)
    at = mph.lookup(hashes)
    columns = {"seed": np.array([seed]), "fingerprint": np.zeros(len(keys), np.uint64), "start": np.zeros(len(keys), np.int64), "count": np.zeros(len(keys), np.int64)}
    columns["fingerprint"][at] = mix(hashes, seed + 4)
    columns["start"][at], columns["count"][at] = starts, counts
    out = io.BytesIO()
    np.savez(out, **columns, **{f"mph_{k}": v for k, v in mph.to_arrays().items()})
    return out.getvalue()


class ShardIndex:
    def __init__(self, data: bytes):
        self.arrays = np.load(io.BytesIO(data))
        self.columns = {k: self.arrays[k] for k in ("seed", "fingerprint", "start", "count")}
        self.mph = MinimalPerfectHash.from_arrays({k: self.arrays[f"mph_{k}"] for k in ("n", "sizes", "ranks")})

    def find(self, keys: np.ndarray, null: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, start, count) of each key."""
        seed = int(self.columns["seed"][0])
        hashes = _hashes(keys, null, number, seed)
        at = self.mph.lookup(hashes)
        if not self.mph.n:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        safe = np.maximum(at, 0)
        found = (at >= 0) & (self.columns["fingerprint"][safe] == mix(hashes, seed + 4))
        return found, self.columns["start"][safe], self.columns["count"][safe]


def _put(fs: pafs.FileSystem, path: str, data_at: str) -> None:
    """Moves a finished file to its name."""
    try:
        fs.move(data_at, path)
    except OSError:
        fs.delete_file(path)
        fs.move(data_at, path)


def _read_ranges(file: pa.NativeFile, start: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> list[bytes | None]:
    """Bytes of each wanted range. Ranges near one another are read at once."""
    out: list[bytes | None] = [None] * len(start)
    rows = np.flatnonzero(wanted)
    rows = rows[np.argsort(start[rows], kind="stable")]
    i = 0
    while i < len(rows):
        low, high, j = int(start[rows[i]]), int(start[rows[i]] + size[rows[i]]), i + 1
        while j < len(rows) and start[rows[j]] - high <= GAP and start[rows[j]] + size[rows[j]] - low <= READ:
            high = max(high, int(start[rows[j]] + size[rows[j]]))
            j += 1
        whole = file.read_at(high - low, low)
        for r in rows[i:j].tolist():
            out[r] = whole[int(start[r]) - low : int(start[r] + size[r]) - low]
        i = j
    return out


@dataclass(frozen=True)
class TokenStore:
    """A written store: uri of its folder, and its manifest (a line for each shard)."""

    uri: str
    manifest: dict

    @classmethod
    def open(cls, uri: str) -> TokenStore:
        fs, at = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(f"{at}/manifest.json") as f:
            return cls(uri, json.loads(f.read()))

    def read(self, keys: DataFrame, *, key_col: str = "doc_id", columns: tuple[str, ...] = ("ids",)) -> DataFrame:
        """The ids of each row of keys (key_col, null too): key, number (of the row among those of its key), start
        (ids of all documents before it), and of COLUMNS those that are asked for: ids (packed in the width of the
        store), n_ids, and ids_crc32 (unsigned, of the ids as 32-bit integers). A key that the store lacks has nulls.
        Input of other columns is not kept."""
        uri, shards = self.uri, self.manifest["shards"]
        width = np.dtype(self.manifest["dtype"]).itemsize
        lows = np.array([s["first"] if s["first"] is not None else -(2**63) for s in shards], np.int64)
        skips = np.array([s["skip"] for s in shards], np.int64)
        base = [s["before"] for s in shards]
        names = [s["name"] for s in shards]

        dtype = self.manifest["dtype"]
        made = {
            "ids": lambda ids: pa.array(ids, pa.binary()),
            "n_ids": lambda ids: pa.array([None if x is None else len(x) // width for x in ids], pa.int64()),
            "ids_crc32": lambda ids: pa.array([None if x is None else zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in ids], pa.int64()),
        }

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _ENCODERS.clear()  # of a store that this worker has written
            for batch in batches:
                k, null = _keys(batch.column(0))
                k = np.where(null, -(2**63), k)
                number = batch.column(1).to_numpy()
                shard = np.maximum(np.searchsorted(lows, k, "right") - 1, 0) if len(lows) else np.full(len(k), -1)
                # Of the shards that begin with the key, the last one that begins at or before the number.
                for row in np.flatnonzero((lows[shard] == k) & (skips[shard] > number)) if len(lows) else ():
                    first = int(np.searchsorted(lows, k[row], "left"))
                    shard[row] = max(0, first + int(np.searchsorted(skips[first : shard[row] + 1], number[row], "right")) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard.astype(np.int64))], names=["key", "number", "shard"])

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _ENCODERS.clear()
            fs, folder = pafs.FileSystem.from_uri(uri)
            now, index, file = None, None, None
            for batch in batches:
                k, null = _keys(batch.column(0))
                number, shard = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                own = number - np.where(np.where(null, -(2**63), k) == lows[np.maximum(shard, 0)], skips[np.maximum(shard, 0)], 0) if len(lows) else number
                for s in np.unique(shard).tolist():
                    rows = np.flatnonzero(shard == s)
                    if s < 0:
                        starts, ids = [None] * len(rows), [None] * len(rows)
                    else:
                        if s != now:
                            if file is not None:
                                file.close()
                            with fs.open_input_file(f"{folder}/{names[s]}.idx") as f:
                                index = ShardIndex(f.read())
                            now, file = s, fs.open_input_file(f"{folder}/{names[s]}.bin")
                        found, at, n = index.find(k[rows], null[rows], own[rows])
                        starts = [base[s] + a if ok else None for ok, a in zip(found.tolist(), at.tolist())]
                        ids = _read_ranges(file, at * width, n * width, found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(number[rows]), pa.array(starts, pa.int64()), *[made[c](ids) for c in columns]], names=["key", "number", "start", *columns]
                    )
            if file is not None:
                file.close()

        plain = keys.select(F.col(key_col).cast("bigint").alias("key"))
        numbered = plain.withColumn("number", (F.row_number().over(W.partitionBy("key").orderBy("key")) - 1).cast("bigint"))
        routed = numbered.mapInArrow(route, "key bigint, number bigint, shard bigint")
        # A number of partitions of its own: by the small keys alone, all shards would be put into few tasks.
        placed = routed.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "key")
        return placed.mapInArrow(fetch, ", ".join(["key bigint, number bigint, start bigint", *[f"{c} {COLUMNS[c]}" for c in columns]]))


def write_store(df: DataFrame, tokenizer_path: str, *, end_id: int, uri: str | None = None, shards: int | None = None, key_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encodes the texts and writes them in ascending order of the keys.

    uri: where to (None: a new folder in the shared one). shards: how many at most (None: the shuffle partitions).
    The driver gets one row for each shard.
    """
    require_columns(df, key_col, text_col)
    spark: SparkSession = df.sparkSession
    uri = uri or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    uri = uri if "://" in uri else f"file://{uri}"
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        fs, folder = pafs.FileSystem.from_uri(uri)
        number = TaskContext.get().partitionId()
        name, own = f"shard-{number:05d}", f"{folder}/attempt-{number:05d}-{uuid.uuid4().hex}"
        keys, nulls, counts = [], [], []
        file = None
        for batch in batches:
            for part in slices(batch, "text"):
                if file is None:
                    fs.create_dir(folder, recursive=True)
                    file = fs.open_output_stream(f"{own}.bin")
                packed = encoder.encode(part.column("text").to_pylist())
                file.write(end.join([*packed, b""]))
                k, null = _keys(part.column("key"))
                keys.append(k)
                nulls.append(null)
                counts += [len(p) // encoder.dtype.itemsize + 1 for p in packed]
        if file is None:
            return
        file.close()
        keys, nulls, counts = np.concatenate(keys), np.concatenate(nulls), np.array(counts, np.int64)
        with fs.open_output_stream(f"{own}.idx") as out:
            out.write(write_index(keys, nulls, np.cumsum(counts) - counts, counts))
        for kind in ("bin", "idx"):
            _put(fs, f"{folder}/{name}.{kind}", f"{own}.{kind}")
        ends = [None if nulls[0] else int(keys[0])], [None if nulls[-1] else int(keys[-1])]
        of_last = int(((keys == keys[-1]) & (nulls == nulls[-1])).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array(ends[0], pa.int64()), pa.array(ends[1], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([of_last], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([str(encoder.dtype.str)])],
            names=["name", "first", "last", "docs", "of_last", "ids", "dtype"],
        )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(key_col).cast("bigint").alias("key"), F.xxhash64(text).alias("hash"), text.alias("text"))
    ordered = rows.repartitionByRange(shards, F.asc_nulls_first("key"), "hash").sortWithinPartitions(F.asc_nulls_first("key"), "hash")
    done = checkpointed(ordered.mapInArrow(write, "name string, first bigint, last bigint, docs bigint, of_last bigint, ids bigint, dtype string"))
    lines = sorted((r.asDict() for r in done.collect()), key=lambda r: r["name"])  # ranges in order
    before, manifest, last = 0, {"dtype": lines[0]["dtype"] if lines else "<u2", "end_id": end_id, "shards": []}, None
    for r in lines:
        skip = 0
        if last is not None and last["last"] == r["first"]:
            skip = last["skip"] + last["docs"] if last["first"] == last["last"] else last["of_last"]
        last = {k: r[k] for k in ("name", "first", "last", "docs", "of_last", "ids")} | {"before": before, "skip": skip}
        manifest["shards"].append(last)
        before += r["ids"]
    fs, folder = pafs.FileSystem.from_uri(uri)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return TokenStore(uri, manifest)
