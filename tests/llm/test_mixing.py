import re
from collections import defaultdict

import pytest

from pitwright.llm import mixing, queries


def plain_targets(sizes):
    """Weights in turn, filled up to twice a source's size, the excess shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def check(docs, rows):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    sums = defaultdict(int)
    for d, _, s in docs:
        sums[s] += size[d]
    target, source = plain_targets(sums), {d: s for d, _, s in docs}
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sums[s])
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    return {s: (taken[s], target[s]) for s in sums}


def test_query_meets_targets_and_reruns_agree(spark, sample):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sample}/documents.parquet").collect()]
    rows = queries.op6_mixing(spark, sample).collect()
    assert len(rows) == len(docs)
    smallest = defaultdict(lambda: 10**9)
    for r in rows:
        s = next(s for d, _, s in docs if d == r.doc_id)
        smallest[s] = min(smallest[s], max(1, r.size))
    for s, (got, want) in check(docs, rows).items():
        assert abs(got - want) <= max(0.05 * want, 2 * smallest[s])
    assert sorted((r.doc_id, r.taken) for r in queries.op6_mixing(spark, sample).collect()) == sorted((r.doc_id, r.taken) for r in rows)


def test_newton_meets_targets_with_priors_and_full_sources(spark):
    sizes = [(i, s, 10 + i % 7, p) for i, (s, p) in enumerate([("a", 1.0), ("a", 0.3), ("b", 1.0), ("c", 2.0), (None, 1.0)] * 40)]
    table = spark.createDataFrame(sizes, "doc_id bigint, source string, size bigint, prior double")
    sums = defaultdict(int)
    for _, s, n, _ in sizes:
        sums[s] += n
    ratio = {"a": 1.2, "b": 1.96, "c": 0.01, None: 2.0}
    targets = spark.createDataFrame([(s, sums[s], ratio[s] * sums[s]) for s in sums], "source string, source_size bigint, target double")
    got = defaultdict(float)
    for r in mixing.mix(table, targets, bucket=30).collect():
        got[r.source] += r.rate * r.size
    for s in sums:
        assert got[s] == pytest.approx(ratio[s] * sums[s], rel=1e-6)


def test_odd_rows(spark, odd, empty):
    rows = mixing.mix_documents(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.copies <= 2 for r in rows)
    none = spark.createDataFrame([(1, "a b", None), (2, None, None), (3, "", "x"), (None, "c", "x")], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_documents(none).collect()}
    assert got[2].size == 0 and got[1].source is None and got[None].source_size == 1
    assert mixing.mix_documents(empty).count() == 0
