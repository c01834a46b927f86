"""SimHash fingerprints, and their links by anchor-point covering.

The anchors are a covering code of the fingerprint space: the product of repetition codes over `blocks` blocks of
bits, so the nearest anchor of a fingerprint is the majority of each of its blocks, and the covering radius R is the
sum of half the blocks' widths. For a threshold t every fingerprint is replicated to the anchors within R + t that a
fingerprint at t or fewer bits could have as its nearest: changing the majority of a block takes a known number of
flips, and those of all changed blocks add up to t at most. So two linked fingerprints meet at the nearest anchor of
each of them, and only fingerprints of the same anchor are compared.

Where very many fingerprints meet at an anchor, they are dealt out once more, by the same code over other bits (each
block takes every blocks-th bit instead of neighbouring ones), and compared at the anchors of both codes.

Equal fingerprints are one row before anything is replicated, so groups of copies cost nothing. Links leave a task as
stars over its own components, never as all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_texts
from .components import components, stars

BITS = 64
SEED = 42
THRESHOLD = 2
SHINGLE = 3
#: Blocks of the covering code: 2 ** BLOCKS anchors. The more anchors, the fewer fingerprints meet at each, and the more
#: replicas each has.
BLOCKS = 16
#: Pairs that are compared at once; those of an anchor beyond which the second code deals its fingerprints out; and
#: replicas that are held at once then.
PAIRS = 1 << 22
CROWD = 1 << 24
HELD = 1 << 22


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 hashes of the text's word shingles, in order; no words: none.

    A-Z are lower-cased; words are runs of other than space and U+0009 to U+000D; fewer words than a shingle has make
    one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :])]
    return np.array(hashes, "<u8")


def fingerprint_of(array: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes: 0."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(array), 1 << 16):
        part = array[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(array), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, *, shingle: int = SHINGLE, text_col: str = "text", fp_col: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (None: all) and the fingerprint as a signed 64-bit integer. A null text has no words."""

    def kernel(texts: list[str]) -> list[list[int]]:
        return [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64).tolist()]

    return map_texts(df, kernel, [(fp_col, "bigint")], text_col=text_col, keep=keep)


def _code(blocks: int) -> list[tuple[int, int, int]]:
    """(shift, mask, majority) of each block."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, (1 << (b - a)) - 1, (b - a + 1) // 2) for a, b in zip(cuts, cuts[1:])]


def home(fps: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest anchor of each fingerprint, and the flips that change the majority of each block."""
    anchor = np.zeros(len(fps), np.int64)
    flips = np.empty((len(fps), blocks), np.int8)
    for b, (shift, mask, most) in enumerate(_code(blocks)):
        ones = np.bitwise_count((fps >> np.uint64(shift)) & np.uint64(mask)).astype(np.int8)
        up = ones >= most
        anchor |= up.astype(np.int64) << b
        flips[:, b] = np.where(up, ones - most + 1, most - ones)
    return anchor, flips


def replicas(fps: np.ndarray, blocks: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row of fps) of all replicas."""
    anchor, flips = home(fps, blocks)
    anchors, rows = [anchor], [np.arange(len(fps))]
    for size in range(1, threshold + 1):
        for chosen in combinations(range(blocks), size):
            at = np.flatnonzero(flips[:, chosen].sum(axis=1) <= threshold)
            anchors.append(anchor[at] ^ sum(1 << b for b in chosen))
            rows.append(at)
    return np.concatenate(anchors), np.concatenate(rows)


def transposed(fps: np.ndarray, blocks: int) -> np.ndarray:
    """The fingerprints with their bits in another order: bit i, i + blocks, i + 2 blocks, ... become neighbours."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    order = np.concatenate([np.arange(b, BITS, blocks) for b in range(blocks)])
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="little")).view("<u8").reshape(-1)


def _crowd(fps: np.ndarray, blocks: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links among fingerprints that all meet at one anchor, by the second code: replicas to its anchors in parts
    that fit, each compared like the anchors of the first code."""
    turned = transposed(fps, blocks)
    back = np.argsort(turned)
    few = turned[: 1 << 10]
    each = max(1, len(replicas(few, blocks, threshold)[0]) // max(1, len(few)))
    parts = -(-len(fps) * each // HELD)
    links = [(fps[:0], fps[:0])]
    for part in range(parts):
        anchors, rows = [], []
        for i in range(0, len(fps), 1 << 14):
            a, r = replicas(turned[i : i + (1 << 14)], blocks, threshold)
            own = a % parts == part
            anchors.append(a[own])
            rows.append(r[own] + i)
        a, r = np.concatenate(anchors), np.concatenate(rows)
        order = np.argsort(a, kind="stable")
        u, v = compare(a[order], turned[r[order]], blocks, threshold, dealt=True)
        links.append(tuple(fps[back[np.searchsorted(turned, x, sorter=back)]] for x in (u, v)))
    return stars(np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links]))


def compare(anchors: np.ndarray, fps: np.ndarray, blocks: int, threshold: int, *, dealt: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Star links among fingerprints of equal anchors; anchors are sorted and whole. dealt: by the second code already,
    so all pairs with one at home are compared."""
    starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    sizes = np.diff(np.r_[starts, len(anchors)])
    group = np.repeat(np.arange(len(starts)), sizes)
    nearest, _ = home(fps, blocks)
    at_home = np.flatnonzero(nearest == anchors)
    work = np.bincount(group[at_home], minlength=len(starts)) * sizes
    crowded = (work > CROWD) & (not dealt)
    links = [_crowd(fps[starts[g] : starts[g] + sizes[g]], blocks, threshold) for g in np.flatnonzero(crowded)]
    at_home = at_home[~crowded[group[at_home]]]
    each = sizes[group[at_home]]
    done = 0
    while done < len(at_home):
        upto = max(done + 1, int(np.searchsorted(np.cumsum(each[done:]), PAIRS, "right")) + done)
        rows, n = at_home[done:upto], each[done:upto]
        first = np.repeat(rows, n)
        second = np.repeat(starts[group[rows]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        near = (np.bitwise_count(fps[first] ^ fps[second]) <= threshold) & (fps[first] < fps[second])
        if near.any():
            links.append(stars(fps[first[near]], fps[second[near]]))
        done = upto
    if not links:
        return fps[:0], fps[:0]
    return stars(np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links]))


def links(distinct: DataFrame, *, threshold: int = THRESHOLD, blocks: int = BLOCKS, fp_col: str = "fp") -> DataFrame:
    """Links (u, v) that join the distinct fingerprints of each component within the threshold."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(whole), 1 << 14):
                fps = whole[i : i + (1 << 14)]
                anchors, rows = replicas(fps, blocks, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(fps[rows].view(np.int64))], names=["anchor", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(last: bool) -> None:
            nonlocal held_a, held_f, waiting, found
            a = np.concatenate([held_a, *[w[0] for w in waiting]])
            f = np.concatenate([held_f, *[w[1] for w in waiting]])
            waiting = []
            cut = len(a) if last else int(np.searchsorted(a, a[-1])) if len(a) else 0
            if cut:
                found.append(compare(a[:cut], f[:cut], blocks, threshold))
                found = [stars(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))]
            held_a, held_f = a[cut:], f[cut:]

        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            if sum(len(w[0]) for w in waiting) >= max(1 << 17, len(held_a)):
                flush(False)
        flush(True)
        for u, v in found:
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    spread = distinct.select(F.col(fp_col).alias("fp")).mapInArrow(replicate, "anchor bigint, fp bigint")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, "u bigint, v bigint")


def rooted(distinct: DataFrame, edges: DataFrame, *, key: str = "fp") -> DataFrame:
    """distinct (key, ...) with root, the same for all keys that the edges (u, v) join."""
    found = components(edges).select(F.col("node").alias("__node"), "root")
    return distinct.join(found, F.col(key) == F.col("__node"), "left").select(*distinct.columns, F.coalesce("root", key).alias("root"))


def classes(fps: DataFrame, *, threshold: int = THRESHOLD, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of fps: the smallest id of its component. Null ids are passed
    over; a component of null ids only has a null component_id."""
    distinct = checkpointed(fps.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("first_id")))
    groups = rooted(distinct, links(distinct, threshold=threshold))
    least = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return groups.join(least, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, *, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) for each row of df (doc_id, text); repeated rows are rows of their own."""
    fps = checkpointed(fingerprints(df, shingle=shingle, keep=["doc_id"]))
    return fps.join(classes(fps, threshold=threshold), "fp").select("doc_id", "fp", "component_id")
