import duckdb
from pyspark.sql import functions as F

from pitwright.llm import quality, queries


def test_query_equals_its_sql(spark, sample):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sample}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op4_quality_rules']}) ORDER BY doc_id").fetchall()
    got = queries.op4_quality_rules(spark, sample).select(names).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_measures_by_hand():
    m = dict(zip(quality.MEASUREMENTS, quality.measure("a b c x a b c\n\n # é\x0b\n # é\x0b\nA1")))
    assert m == {"n_words": 12, "word_chars": 13, "n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": 6, "n_lines": 4, "n_upper": 1, "n_lower": 7, "n_digits": 1}
    assert quality.repeat_words("a a a a".encode().split()) == 4 and quality.repeat_words(b"a a a".split()) == 0
    assert quality.measure("")[0] == 0


def test_ablations_equal_counts(spark, sample):
    rows = quality.ledger(spark.read.parquet(f"{sample}/documents.parquet")).collect()
    mask = quality.mask_of(quality.POLICIES[quality.POLICY])
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in quality.ablations(spark.createDataFrame([(r.failed,) for r in rows], "failed bigint")).collect()}
    for rule in quality.RULES:
        bit = 1 << rule.bit
        want = (sum(r.failed & bit > 0 for r in rows), sum(r.failed & mask == bit for r in rows), sum(r.failed & mask & ~bit == 0 for r in rows))
        assert got[rule.name] == want


def test_labelled_documents(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").join(spark.read.parquet(f"{sample}/labels.parquet"), "doc_id")
    rows = quality.ledger(docs).withColumn("kept", quality.verdict()).where("n_words >= 50").collect()
    poor, clean = [r for r in rows if not r.quality], [r for r in rows if r.quality]
    assert not any(r.kept for r in poor) and sum(r.kept for r in clean) >= 0.97 * len(clean)


def test_odd_rows(odd, empty):
    rows = quality.ledger(odd).collect()
    assert len(rows) == odd.count() and all(r.failed & 1 for r in rows if not r.text)
    kept = quality.filter_quality(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.failed & quality.mask_of(quality.POLICIES[quality.POLICY]) == 0 for r in rows)
    assert quality.filter_quality(empty).count() == 0
    assert quality.ledger(odd.withColumn("failed", F.lit("x"))).where("failed >= 0").count() == odd.count()
