"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of `length` bytes that also starts earlier (in a document of smaller id, or earlier in
the same document) is removed. Suffix arrays are built over blocks that hold all possible copies of their strings:

1. A string of `length` bytes is routed by its anchor, the least of the hashes of its ANCHOR-byte pieces, which depends
   on its bytes alone; so all copies of a string have one anchor. Neighbouring strings mostly share theirs: a run of
   them is one row with the hash of its bytes (the context).
2. Equal contexts of an anchor are aggregated, once before the shuffle and once after it: all strings of all but the
   first are repeats. Anchors with one context need no more.
   The strings of an anchor with more than `hot` of them are dealt out one by one, under the hash of each, so an anchor
   never makes a block that is larger than that.
3. Where an anchor has several contexts, the first of each is put into a block, with all of its anchor. The block's
   suffix array is sorted in two stages: only suffixes smaller than their successors are sorted directly, the others
   are induced by scans over the buckets of first bytes. Suffixes whose adjacent common prefix is `length` or more are
   copies, and all but the first of them are repeats.
4. The repeats' spans are joined back to the documents and cut out.

Ids are ordered null first; rows of one id in the order of the XXH64 of their texts, repeated rows one after another. A
null text is an empty text. Texts shorter than `length` bytes stay whole. Contexts are compared by two independent 64-bit hashes
(anchor and context); the block compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import require_columns, slices
from .mph import mix

LENGTH = 100
ANCHOR = 24
#: Bytes of contexts in a block, strings of an anchor beyond which it is split, and string starts of a text that are
#: hashed at once.
BLOCK = 2 << 20
HOT = 1 << 17
PIECE = 1 << 22
SEPARATOR = 0xFF  # in no UTF-8 text
FIRST_KEY = -(2**63)  # for null ids


def _combine(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    return (a * np.uint64(by)) ^ (b + (a >> np.uint64(29)))


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all ANCHOR-byte pieces."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h = _combine(h[:-1], h[1:], 0x9E3779B97F4A7C15)
        h = _combine(h[:-2], h[2:], 0xC2B2AE3D27D4EB4F)
        h = _combine(h[:-4], h[4:], 0x165667B19E3779F9)
        wide = _combine(h[:-8], h[8:], 0xBF58476D1CE4E5B9)
        h = _combine(wide[:-8], h[16:], 0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def runs(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, number of strings) of the runs of neighbouring strings of one anchor at one place."""
    keys = piece_hashes(data)
    width = length - ANCHOR + 1
    least, span = keys, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(keys) - width + 1
    least = np.minimum(least[:n], least[width - span : width - span + n])
    cut = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (keys[: n - 1] == least[:-1])])
    return least[cut], cut, np.diff(np.r_[cut, n])


def two_stage_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted starts in the order of their suffixes, right to `depth` bytes at least. The last byte must be
    SEPARATOR and followed, within the array, by `depth` + 8 more bytes."""
    n = len(data)
    rising = np.empty(n, bool)  # smaller than its successor
    differs = np.flatnonzero(data[1:] != data[:-1])
    to = np.searchsorted(differs, np.arange(n))
    inside = to < len(differs)
    at = differs[np.minimum(to, len(differs) - 1)] if len(differs) else np.zeros(n, np.int64)
    rising[:] = inside & (data[at] < data[np.minimum(at + 1, n - 1)])
    member = np.zeros(n, bool)
    member[wanted] = True
    grow = wanted[~rising[wanted]] + 1  # successors of falling suffixes are sorted too
    while len(grow):
        grow = grow[~member[grow]]
        member[grow] = True
        grow = grow[~rising[grow] & (grow + 1 < n)] + 1
    wide = np.zeros(n, np.uint64)
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    for k in range(8):
        wide |= padded[k : k + n] << np.uint64(56 - 8 * k)
    direct = np.flatnonzero(member & rising)
    direct = direct[np.argsort(wide[direct], kind="stable")]
    first = np.r_[True, wide[direct][1:] != wide[direct][:-1]] if len(direct) else np.zeros(0, bool)
    for deep in range(8, depth + 8, 8):
        alone = first & np.r_[first[1:], True]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(first)[tied]
        word = wide[np.minimum(direct[tied] + deep, n - 1)]
        by = np.lexsort((word, group))
        direct[tied] = direct[tied][by]
        word = word[by]
        first[tied[1:]] |= word[1:] != word[:-1]
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    ends = np.searchsorted(data[direct], np.arange(257))
    falling = member & ~rising
    order = []
    for c in range(256):
        left = np.concatenate(induced[c]) if induced[c] else direct[:0]
        fresh = left
        while len(fresh):
            fresh = fresh[fresh > 0] - 1
            fresh = fresh[falling[fresh] & (data[fresh] == c)]
            left = np.r_[left, fresh]
        bucket = np.r_[left, direct[ends[c] : ends[c + 1]]]
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[falling[before] & (data[before] > c)]
        if len(before):
            by = np.argsort(data[before], kind="stable")
            before = before[by]
            kinds = data[before]
            cuts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(before)]):
                induced[kinds[a]].append(before[a:b])
    order = np.concatenate(order)
    asked = np.zeros(n, bool)
    asked[wanted] = True
    return order[asked[order]]


def adjacent_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, `most` bytes at most; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for k in range(most):
        if not len(alive):
            break
        alive = alive[data[order[alive] + k] == data[order[alive - 1] + k]]
        out[alive] += 1
    return out


def repeats(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, in the order of precedence, the starts whose string of `length` bytes also starts earlier."""
    data = np.frombuffer(bytes([SEPARATOR]).join([*contexts, bytes(length + 16)]), np.uint8)
    data = np.r_[data[: -(length + 16)], np.full(length + 16, SEPARATOR, np.uint8)]
    sizes = np.array([len(c) for c in contexts], np.int64)
    at = np.cumsum(np.r_[0, sizes[:-1] + 1])
    strings = np.maximum(sizes - length + 1, 0)
    wanted = np.repeat(at, strings) + np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    order = two_stage_order(data, wanted, length)
    group = np.cumsum(adjacent_prefixes(data, order, length) < length)
    earliest = np.full(group[-1] + 1 if len(group) else 0, len(data), np.int64)
    np.minimum.at(earliest, group, order)
    again = np.sort(order[order != earliest[group]])
    owner = np.searchsorted(at, again, "right") - 1
    cut = np.searchsorted(owner, np.arange(len(contexts) + 1))
    return [again[a:b] - s for a, b, s in zip(cut, cut[1:], at.tolist())]


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for part in slices(batch, "text"):
            rows: list[tuple] = []
            for k, th, rn, raw in zip(*[part.column(c).to_pylist() for c in ("k", "th", "rn", "text")]):
                if rn > 1:  # a repeated row is a repeat as a whole
                    continue
                for a in range(0, len(raw) - length + 1, PIECE):
                    data = raw[a : a + PIECE + length - 1]
                    anchor, start, n = runs(np.frombuffer(data, np.uint8), length)
                    ends = (start + n + length - 1).tolist()
                    context = np.fromiter((digest(data[s:e]) for s, e in zip(start.tolist(), ends)), np.uint64, len(start))
                    rows.append((anchor.view(np.int64), context.view(np.int64), np.full(len(n), k, np.int64), np.full(len(n), th, np.int64), start + a, n.astype(np.int32)))
            if rows:
                columns = _first_of_each([np.concatenate(c) for c in zip(*rows)], length)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "context", "k", "th", "start", "n", "sure"])


def _first_of_each(rows: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The rows with `sure`: of equal contexts of an anchor the first stays as it is; the others, repeats for sure,
    become one row for each stretch that they cover, under an anchor of its own that deals them out evenly."""
    anchor, context, k, th, start, n = rows
    order = np.lexsort((start, th, k, context, anchor))
    first = np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (context[order][1:] != context[order][:-1])]
    kept, again = order[first], order[~first]
    again = again[np.lexsort((start[again], th[again], k[again]))]
    end = start[again] + n[again] + length - 1
    cut = np.ones(len(again), bool)
    cut[1:] = (k[again][1:] != k[again][:-1]) | (th[again][1:] != th[again][:-1]) | (start[again][1:] > end[:-1])
    at = np.flatnonzero(cut)
    last = np.r_[at[1:] - 1, len(again) - 1] if len(at) else at
    some = again[at]
    spread = mix(k[some].view(np.uint64) ^ th[some].view(np.uint64) ^ mix(start[some].view(np.uint64), 1), 2).view(np.int64)
    parts = [(anchor[kept], spread), (context[kept], np.zeros(len(some), np.int64)), (k[kept], k[some]), (th[kept], th[some]), (start[kept], start[some]), (n[kept].astype(np.int64), end[last] - start[some] - length + 1)]
    return [np.concatenate(p) for p in parts] + [np.r_[np.zeros(len(kept), bool), np.ones(len(some), bool)]]


def _fetch(batches: Iterator[pa.RecordBatch], length: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the contexts that are asked for; those of an anchor with over `hot` strings string by string."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for part in slices(batch, "text"):
            out: list[tuple] = []
            for k, th, rn, raw, asked in zip(*[part.column(c).to_pylist() for c in ("k", "th", "rn", "text", "asked")]):
                if rn > 1:
                    continue
                for x in asked:
                    a, n = x["start"], x["n"]
                    if x["strings"] <= hot:
                        out.append((x["anchor"], k, th, a, raw[a : a + n + length - 1]))
                    else:
                        strings = [raw[i : i + length] for i in range(a, a + n)]
                        own = np.fromiter(map(digest, strings), np.uint64, n).view(np.int64).tolist()
                        out += [(h, k, th, a + i, s) for i, (h, s) in enumerate(zip(own, strings))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "k", "th", "start", "bytes"])


def _settle(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the repeats of blocks; rows are sorted by anchor."""
    held: list[tuple] = []
    size = 0

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[1:4])
        out: list[tuple] = []
        for (_, k, th, start, _), again in zip(rows, repeats([r[4] for r in rows], length)):
            if len(again):
                cut = np.flatnonzero(np.r_[True, np.diff(again) > 1])
                last = again[np.r_[cut[1:] - 1, len(again) - 1]]
                out += [(k, th, start + a, start + b + length) for a, b in zip(again[cut].tolist(), last.tolist())]
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "th", "start", "end"])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "k", "th", "start", "bytes")]):
            if size >= BLOCK and row[0] != held[-1][0]:
                yield spans(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield spans(held)


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(df: DataFrame, *, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of df, with spans (removed runs: start and end in bytes, in order), kept (the other bytes) and
    kept_text (they as text, without characters of which only a part is left; null for a null text).

    Columns of df named spans, kept or kept_text are replaced. length: ANCHOR bytes at least.
    """
    require_columns(df, id_col, text_col)
    if length < ANCHOR:
        raise ValueError(f"length must be {ANCHOR} at least")
    names = [c for c in df.columns if c not in ("spans", "kept", "kept_text")]
    rest = [c for c in names if c != text_col]
    plain = df.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(FIRST_KEY)).alias("k"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("th"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(f"`{text_col}`").isNull().alias("none"))
    # By text too, so that rows of one id are dealt to many tasks.
    rows = plain.repartition("k", "th").withColumn("rn", F.row_number().over(W.partitionBy("k", "th").orderBy("none")))
    # All uses read the same columns, so that the texts are shuffled once and their exchange is reused.
    columns = ["k", "th", "rn", "text", "rest", "none"]

    found = rows.select(columns).mapInArrow(lambda b: _anchors(b, length), "anchor bigint, context bigint, k bigint, th bigint, start bigint, n bigint, sure boolean").repartition("anchor")
    own, same = W.partitionBy("anchor"), W.partitionBy("anchor", "context").orderBy("k", "th", "start")
    classed = found.withColumn("place", F.row_number().over(same)).withColumn("mixed", F.min("context").over(own) != F.max("context").over(own)).withColumn("strings", F.sum("n").over(own))
    whole = classed.where("sure or place > 1").select("k", "th", "start", (F.col("start") + F.col("n") + length - 1).alias("end"))
    asked = classed.where("not sure and place = 1 and mixed").groupBy("k", "th").agg(F.collect_list(F.struct("anchor", "start", "n", "strings")).alias("asked"))
    contexts = rows.select(columns).join(asked, ["k", "th"]).mapInArrow(lambda b: _fetch(b, length, hot), "anchor bigint, k bigint, th bigint, start bigint, bytes binary")
    settled = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _settle(b, length), "k bigint, th bigint, start bigint, end bigint")
    marks = whole.unionByName(settled).groupBy("k", "th").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    marked = rows.select(columns).join(marks, ["k", "th"], "left")

    schema = "rest struct<%s>, text string, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_text string" % ", ".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in rest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                spans, kept, texts, left = [], [], [], []
                for rn, raw, none, marks in zip(*[part.column(c).to_pylist() for c in ("rn", "text", "none", "marks")]):
                    if rn > 1:
                        runs_ = [(0, len(raw))] if len(raw) >= length else []
                    else:
                        runs_ = union_of([(m["start"], m["end"]) for m in marks or []])
                    ends = [0, *[b for _, b in runs_]]
                    kept.append(b"".join([raw[a:b] for a, b in zip(ends, [*[a for a, _ in runs_], len(raw)])]))
                    spans.append([{"start": a, "end": b} for a, b in runs_])
                    texts.append(None if none else raw.decode("utf-8", "replace"))
                    left.append(None if none else kept[-1].decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("rest"), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(left, pa.string())], names=["rest", "text", "spans", "kept", "kept_text"]
                )

    out = marked.select("rn", "text", "none", "rest", "marks").mapInArrow(cut, schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in names], "spans", "kept", "kept_text")
