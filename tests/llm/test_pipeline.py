import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

from pitwright.llm import quality, simhash

from .test_mixing import plain_targets
from .test_simhash import plain_components, plain_fingerprint
from .test_suffix import plain


def test_stages_equal_brute_force(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    names = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    mask = quality.mask_of(quality.POLICIES[quality.POLICY])

    kept = cp.quality_rules(spark, docs, sample)
    ledger = {r.doc_id: r.failed for r in quality.ledger(docs).collect()}
    rows = [r for r in rows if not ledger[r[0]] & mask]
    assert sorted(map(tuple, kept.collect())) == sorted(rows) and kept.columns == names

    now = spark.createDataFrame(rows, docs.schema)
    single = cp.simhash_near_dedup(spark, now, sample)
    fps = [(r[0], plain_fingerprint(r[1], cp.SHINGLE)) for r in rows]
    rows = [r for r, c in zip(rows, plain_components(fps, cp.THRESHOLD)) if r[0] == c]
    assert sorted(map(tuple, single.collect())) == sorted(rows) and single.columns == names

    now = spark.createDataFrame(rows, docs.schema)
    cut = cp.suffix_array_dedup(spark, now, sample)
    rows.sort()
    texts = [kept.decode("utf-8", "ignore") for _, kept in plain([r[1].encode() for r in rows], 100)]
    rows = [(r[0], t, *r[2:4], len(t)) for r, t in zip(rows, texts)]
    assert sorted(map(tuple, cut.collect())) == sorted(rows) and cut.columns == names

    now = spark.createDataFrame(rows, docs.schema)
    mixed = cp.mix_sources(spark, now, sample)
    got = [tuple(r) for r in mixed.collect()]
    assert mixed.columns == names and set(got) <= set(rows) and max(map(got.count, set(got))) <= 2
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    size, taken, largest = {}, {}, {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + count(r[1])
        largest[r[3]] = max(largest.get(r[3], 0), count(r[1]))
    for r in got:
        taken[r[3]] = taken.get(r[3], 0) + count(r[1])
    for s, t in plain_targets(size).items():
        assert abs(taken.get(s, 0) - t) <= max(0.1 * t, largest[s] / 2)

    out = cp.encode(spark, spark.createDataFrame(got, docs.schema), sample).collect()
    assert len(out) == len(got) and all(r.intact and r.n_tokens * 4 == len(r.ids) for r in out)


def test_odd_rows_pass_all_stages(spark, odd, empty):
    for docs in (odd, empty):
        now = docs.select("doc_id", "text", "lang", "source", F.lit(1).cast("bigint").alias("n_chars"))
        for name, stage in cp.STAGES:
            now = stage(spark, now, "")
        assert now.count() <= 2 * docs.count()


def test_near_duplicate_stage_keeps_one_of_each_group(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", F.lit(1).cast("bigint").alias("n_chars"))
    kept = cp.simhash_near_dedup(spark, docs, "").collect()
    rows = [(r.doc_id, plain_fingerprint(r.text, cp.SHINGLE)) for r in docs.collect()]
    groups = {c for (d, f), c in zip(rows, plain_components(rows, cp.THRESHOLD)) if c is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(groups)
    assert simhash.THRESHOLD == cp.THRESHOLD
