from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pitwright.llm import queries, simhash
from pitwright.llm.components import components


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, threshold=2):
    """{row: smallest id} by comparing all pairs."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= threshold:
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(fps):
        if d is not None:
            ids[root(i)].append(d)
    return [min(ids[root(i)], default=None) for i in range(len(fps))]


def test_query_equals_brute_force(spark, sample):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sample}/documents.parquet").collect()]
    fps = [(d, plain_fingerprint(t)) for d, t in docs]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(fps, plain_components(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_links(spark, sample).collect()}
    assert got == want


def test_odd_rows(odd, empty):
    rows = sorted([(r.doc_id or 0, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(odd).collect()], key=str)
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in odd.collect()]
    assert rows == sorted([(d or 0, f, c) for (d, f), c in zip(docs, plain_components(docs))], key=str)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_crowded_anchors_are_whole(spark):
    rng = np.random.default_rng(0)
    fps = [0, 1, 3, 7, 2**63, 2**64 - 1]
    for _ in range(400):
        x = fps[rng.integers(len(fps))]
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        fps.append(x)
    fps = sorted(set(fps))
    table = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)), i) for i, f in enumerate(fps)], "fp bigint, doc_id bigint")
    for blocks in (16, 21):
        edges = simhash.links(table, threshold=2, blocks=blocks)
        assert all(((u ^ v) % 2**64).bit_count() for u, v in edges.collect())
        rooted = table.join(components(edges), F.col("fp") == F.col("node"), "left").select("doc_id", F.coalesce("root", "fp").alias("root"))
        groups = defaultdict(set)
        for r in rooted.collect():
            groups[r.root].add(r.doc_id)
        want = defaultdict(set)
        for i, c in enumerate(plain_components([(i, f) for i, f in enumerate(fps)])):
            want[c].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_crowds_are_linked_as_all_pairs_are():
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 63))
    fps = {base}
    while len(fps) < 3000:
        x = base if rng.random() < 0.5 else int(rng.choice(list(fps)[:50]))
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    array = np.array(sorted(fps), np.uint64)
    assert len(np.unique(simhash.transposed(array, 16))) == len(array)
    for threshold in (1, 2, 3):
        u, v = simhash._crowd(array, 16, threshold)
        label = {int(f): int(f) for f in array} | {int(a): int(b) for a, b in zip(u, v)}
        groups = defaultdict(set)
        for i, f in enumerate(array.tolist()):
            groups[label[f]].add(i)
        near = np.bitwise_count(array[:, None] ^ array[None]) <= threshold
        a, b = simhash.stars(*(array[x] for x in np.nonzero(near & ~np.eye(len(array), dtype=bool))))
        want = defaultdict(set)
        label = {int(f): int(f) for f in array} | {int(x): int(y) for x, y in zip(a, b)}
        for i, f in enumerate(array.tolist()):
            want[label[f]].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_several_parts(spark, monkeypatch):
    from pitwright.llm import components as module

    monkeypatch.setattr(module, "PART", 40)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001)] + [(0, 2000 + i) for i in range(100)], "u bigint, v bigint").repartition(7)
    got = {r.node: r.root for r in module.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{2000 + i: 0 for i in range(100)}, 1000: 1000, 1001: 1000, 1002: 1000}
    assert module.components(edges.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (1002, 1001)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}
