import random

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F

from pitwright.llm import nearcopy

from .test_simhash import plain_fingerprint


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(words, n, rng):
    words = list(words)
    for i in range(n):
        words[(2 * i + 1) * len(words) // (2 * n)] = f"new{rng.random()}"
    return " ".join(words)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))


def test_edited_copies_are_linked_and_others_stay(spark):
    rng = random.Random(1)
    rows, want = [], []
    for g in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        near, other = edited(words, 6, rng), edited(words, 12, rng)
        assert likeness(" ".join(words), near) >= 0.8 > likeness(" ".join(words), other)
        rows += [(3 * g, " ".join(words)), (3 * g + 1, near), (3 * g + 2, other)]
        want += [3 * g] + [3 * g + 2] * (likeness(near, other) < 0.8)
    bits = [(plain_fingerprint(rows[3 * g][1], 5) ^ plain_fingerprint(rows[3 * g + 1][1], 5)).bit_count() for g in range(20)]
    assert sum(b > cp.THRESHOLD for b in bits) > 10
    assert sorted(r.doc_id for r in dict(cp.STAGES)["simhash_near_dedup"](spark, table(spark, rows), "").collect()) == want


def test_large_group_of_near_copies_is_one(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, edited(words, 3, rng)) for i in range(200)]
    assert [r.doc_id for r in dict(cp.STAGES)["simhash_near_dedup"](spark, table(spark, rows), "").collect()] == [0]


def test_loose_group_equals_brute_force(spark):
    """Many texts share bands, and only some of them are alike."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]

    def changed(n):
        own = list(words)
        for i in rng.sample(range(200), n):
            own[i] = f"new{rng.random()}"
        return " ".join(own)

    texts = [changed(n) for n in [1] * 20 + [2] * 40 + [3] * 60 + [4] * 60 + [6] * 40 + [8] * 40]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    fps = [plain_fingerprint(t, 5) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            near = (fps[i] ^ fps[j]).bit_count() <= cp.THRESHOLD
            if (near or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    want = sorted(set(label))
    assert 20 < len(want) < 150
    kept = dict(cp.STAGES)["simhash_near_dedup"](spark, table(spark, list(enumerate(texts))), "").collect()
    assert sorted(r.doc_id for r in kept) == want


def test_long_groups_are_linked_in_blocks():
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64))
    nodes = np.arange(len(fps))
    u, v = nearcopy._ordered(*nearcopy.trees(nodes[64:], fps[64:], (nodes[:64], fps[:64])))
    assert set(u.tolist()) | set(v.tolist()) == set(nodes.tolist()) and len(u) < 1.1 * len(fps)


def test_tree_spans_with_least_distances():
    fps = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 200, np.uint64))
    a, b = (fps[x] for x in nearcopy.tree(fps))
    label = {int(f): {int(f)} for f in fps}
    for d, (u, v) in sorted(((int(u) ^ int(v)).bit_count(), (int(u), int(v))) for u, v in zip(a, b)):
        left = label[u]
        assert v not in left
        assert all((x ^ y).bit_count() >= d for x in left for y in label[v])
        left |= label[v]
        for x in left:
            label[x] = left
    assert len(label[int(fps[0])]) == len(fps)
