"""Near copies: links of texts whose sets of word shingles have a Jaccard likeness of `at_least` or more.

Candidates are found by MinHash: BANDS bands of ROWS least values each; texts of likeness j share a band with
probability 1 - (1 - j ** ROWS) ** BANDS, which is 0.999997 at 0.8 whatever the length of the texts. A candidate
becomes a link only if the exact likeness of the two sets is high enough. Before texts are fetched for that, candidates
whose BANDS * ROWS least values agree in fewer than AGREE places are dropped: a pair of likeness 0.8 is one of these
with a probability of about 0.000002, so what the bands find is not lost again.

Links are made in two rounds, so that groups of near copies cost nothing like the square of their size:

1. A band's group gives the edges of a spanning tree of least SimHash distances; a large one those of the trees of its
   blocks, each together with a few of the group's first texts. After exact verification most groups are one component.
2. In the groups that are not, pairs of texts of different components are compared in blocks of SIDE texts a side, each
   pair in the first band that it shares: those that agree in AGREE places are verified there and then, by their sets.
   What links joins no further pairs, so a block gives a forest of links and not its pairs.

Texts are told apart by a 64-bit hash (node); a text without words has no band and no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_texts, slices, small_or_shuffled
from .simhash import fingerprint_of, rooted, shingle_hashes

BANDS = 24
ROWS = 4
#: Texts of a block, and those of a group's first ones that are in each.
BLOCK = 2048
FIRST = 64
SIDE = 1024
AGREE = 57
#: Rows of one group that a task holds; and pairs that are looked at together.
HELD = 1 << 16
PAIRS = 1 << 18
AT_LEAST = 0.8
_rng = np.random.default_rng(42)
_TIMES = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def least_values(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[None, i : i + (1 << 12)] * _TIMES + _PLUS).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """Keys of the bands."""
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def node(text: Column) -> Column:
    """The hash that stands for a text; null: that of an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketches(df: DataFrame, *, shingle: int, keep: list[str]) -> DataFrame:
    """The columns keep, and fp, bands (none for a text without words) and sketch, the last bytes of the least values."""

    def kernel(texts: list[str]) -> list[list]:
        fps, keys, lasts = [], [], []
        for t in texts:
            hashes = shingle_hashes(t, shingle)
            fps.append(fingerprint_of(hashes))
            least = least_values(np.unique(hashes))
            keys.append(bands(least) if len(hashes) else [])
            lasts.append((least & np.uint64(255)).astype(np.uint8).tobytes())
        return [np.array(fps, np.uint64).view(np.int64).tolist(), keys, lasts]

    return map_texts(df, kernel, [("fp", "bigint"), ("bands", "array<bigint>"), ("sketch", "binary")], keep=keep)


def tree(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places in fps) of a spanning tree of least distances, in memory that is linear in their number."""
    n = len(fps) - 1
    left, at = fps[1:].copy(), np.arange(1, n + 1)
    near = np.zeros(n, np.int64)
    far = np.bitwise_count(left ^ fps[0])
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(n):
        m = n - k
        i = int(far[:m].argmin())
        now = left[i]
        a[k], b[k] = at[i], near[i]
        for x in (left, at, near, far):
            x[i] = x[m - 1]
        d = np.bitwise_count(left[: m - 1] ^ now)
        closer = d < far[: m - 1]
        far[: m - 1][closer] = d[closer]
        near[: m - 1][closer] = a[k]
    return a, b


def trees(nodes: np.ndarray, fps: np.ndarray, first: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the trees of blocks of nodes, each together with `first` (nodes and their fingerprints)."""
    step = BLOCK - len(first[0])
    out = []
    for i in range(0, len(nodes), step):
        own = np.r_[first[0], nodes[i : i + step]]
        a, b = tree(np.r_[first[1], fps[i : i + step]])
        out.append((own[a], own[b]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    both = both[:, both[0] != both[1]]
    return both[0], both[1]


def candidates(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (u < v) of nodes of equal keys; keys are sorted and whole."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    first, second = [nodes[:0]], [nodes[:0]]
    for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        own = nodes[s : s + n]
        bits = fps[s : s + n]
        first_of = min(FIRST, n - 1)
        a, b = trees(own[first_of:], bits[first_of:], (own[:first_of], bits[:first_of]))
        first.append(a)
        second.append(b)
    return _ordered(np.concatenate(first), np.concatenate(second))


def pairs(distinct: DataFrame) -> DataFrame:
    """Candidates (u, v) of the first round, of distinct (node, fp, bands)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = none, none, none.view(np.uint64)
        waiting: list[tuple[np.ndarray, ...]] = []
        #: The key of a group that is too large to be held, and its first nodes and fingerprints.
        long: tuple[int, tuple[np.ndarray, np.ndarray]] | None = None

        def flush(last: bool) -> list[tuple[np.ndarray, np.ndarray]]:
            nonlocal held, waiting, long
            k, node, fp = (np.concatenate(c) for c in zip(held, *waiting))
            waiting, out = [], []
            if long is not None and len(k):
                end = int(np.searchsorted(k, long[0], "right"))
                if end:
                    out.append(_ordered(*trees(node[:end], fp[:end], long[1])))
                if end < len(k):
                    long = None
                k, node, fp = k[end:], node[end:], fp[end:]
            cut = len(k) if last else int(np.searchsorted(k, k[-1])) if len(k) else 0
            if cut:
                out.append(candidates(k[:cut], node[:cut], fp[:cut]))
            held = k[cut:], node[cut:], fp[cut:]
            if len(held[0]) > HELD:
                _, node, fp = held
                long = int(held[0][0]), (node[:FIRST], fp[:FIRST])
                out.append(_ordered(*trees(node[FIRST:], fp[FIRST:], long[1])))
                held = tuple(x[:0] for x in held)
            return out

        def batch_of(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["u", "v"])

        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)))
            if sum(len(w[0]) for w in waiting) >= 1 << 17:
                yield from map(batch_of, flush(False))
        yield from map(batch_of, flush(True))

    spread = distinct.select(F.explode("bands").alias("key"), "node", "fp")
    return spread.repartition("key").sortWithinPartitions("key", "node").mapInArrow(meet, "u bigint, v bigint").distinct()


class Members:
    """Rows of a band's group: nodes, numbers of their roots, sketches, bands and sorted sets of hashes."""

    def __init__(self, rows: list[tuple], roots: dict[int, int]):
        self.node = np.array([r[0] for r in rows], np.int64)
        self.root = [roots.setdefault(r[1], len(roots)) for r in rows]
        self.sketch = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        self.bands = np.array([r[3] for r in rows], np.int64).reshape(len(rows), -1)
        self.words = [np.frombuffer(r[4], np.uint64) for r in rows]
        self.size = np.array([len(w) for w in self.words])


def across(left: Members, right: Members, key: int, roots: dict[int, int], at_least: float) -> list[tuple[int, int]]:
    """Links between texts of different roots that are alike; the roots that they join count as one from then on."""
    parent = list(range(len(roots)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    band = int(np.flatnonzero(left.bands[0] == key)[0]) if len(left.node) else 0
    other = np.array(right.root)
    step = max(1, PAIRS // max(1, len(right.node)))
    for i in range(0, len(left.node), step):
        small, large = (f(left.size[i : i + step, None], right.size[None]) for f in (np.minimum, np.maximum))
        a, b = np.nonzero((np.array(left.root[i : i + step])[:, None] != other[None]) & (small >= at_least * large))
        same = left.bands[i : i + step][a] == right.bands[b]
        first = same.argmax(axis=1) == band
        a, b = a[first], b[first]
        alike = (left.sketch[i : i + step][a] == right.sketch[b]).sum(axis=1) >= AGREE
        for x, y in zip((a[alike] + i).tolist(), b[alike].tolist()):
            p, q = find(left.root[x]), find(right.root[y])
            if p == q:
                continue
            u, v = left.words[x], right.words[y]
            at = np.minimum(np.searchsorted(v, u), len(v) - 1)
            common = int((v[at] == u).sum())
            if common >= at_least * (len(u) + len(v) - common):
                parent[p] = q
                out.append((int(left.node[x]), int(right.node[y])))
    return out


def rest(groups: DataFrame, texts: DataFrame, *, shingle: int, at_least: float) -> DataFrame:
    """Verified links (u, v) of the second round, of groups (node, root, bands, sketch) and texts (node, text)."""

    def packed(batch: list[str]) -> list[list]:
        return [[np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch]]

    spread = groups.select(F.explode("bands").alias("key"), "node", "root")
    large = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 and low != high")
    members = checkpointed(spread.join(large.select("key", "n"), "key"))
    one = texts.join(small_or_shuffled(checkpointed(members.select("node").distinct())), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    sets = map_texts(one, packed, [("words", "binary")], keep=["node"]).join(groups.select("node", "sketch", "bands"), "node")
    blocks = F.ceil(F.col("n") / SIDE).cast("int")
    own = members.join(checkpointed(sets), "node").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = own.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "sketch", "bands", "words")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def flush() -> pa.RecordBatch:
            roots: dict[int, int] = {}
            left, right = (Members([r[1:] for r in held if r[0] == side], roots) for side in now[1:])
            found = across(left, right, now[0], roots, at_least)
            u, v = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for part in slices(batch, "words"):
                for key, i, j, *row in zip(*[c.to_pylist() for c in part.columns]):
                    if now != (key, i, j):
                        if held:
                            yield flush()
                        held, now = [], (key, i, j)
                    held.append(tuple(row))
        if held:
            yield flush()

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(meet, "u bigint, v bigint").distinct()


def agreeing(found: DataFrame, sketched: DataFrame) -> DataFrame:
    """Those of found (u, v) that agree in AGREE places; sketched: (node, sketch)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("a", "b"))
            good = pa.array((a == b).sum(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("u", "v")], names=["u", "v"])

    side = lambda n, s: sketched.select(F.col("node").alias(n), F.col("sketch").alias(s))
    return found.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(keep, "u bigint, v bigint")


def verified(found: DataFrame, texts: DataFrame, *, shingle: int, at_least: float) -> DataFrame:
    """Those of found (u, v) whose texts (node, text) are alike."""

    def sets(batch: list[str]) -> list[list]:
        return [[np.unique(shingle_hashes(t, shingle)).view(np.int64).tolist() for t in batch]]

    ends = checkpointed(found.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    one = texts.join(small_or_shuffled(ends), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    whole = checkpointed(map_texts(one, sets, [("words", "array<bigint>")], keep=["node"]))
    both = found.join(whole.select(F.col("node").alias("u"), F.col("words").alias("a")), "u").join(whole.select(F.col("node").alias("v"), F.col("words").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= at_least * (F.size("a") + F.size("b") - common)).select("u", "v")


def links(texts: DataFrame, distinct: DataFrame, known: DataFrame, *, shingle: int, at_least: float = AT_LEAST) -> DataFrame:
    """Verified links (u, v) that join, together with known (u, v), all nodes that near copies join. texts: (node,
    text); distinct: (node, fp, bands, sketch), a row for each node."""
    first = checkpointed(verified(checkpointed(agreeing(pairs(distinct), distinct.select("node", "sketch"))), texts, shingle=shingle, at_least=at_least))
    groups = checkpointed(rooted(distinct.select("node", "bands", "sketch"), known.unionByName(first), key="node"))
    return first.unionByName(checkpointed(rest(groups, texts, shingle=shingle, at_least=at_least)))
