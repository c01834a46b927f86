import random

import corpus_pipeline as cp
from pyspark.sql import functions as F


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))


def test_equal_ids_with_unlinked_texts_stay(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(5)]
    rows = [(7, t) for t in texts] + [(7, texts[0]), (8, texts[1]), (None, texts[2]), (None, "no id"), (None, "no id")]
    kept = [(r.doc_id, r.text) for r in dict(cp.STAGES)["simhash_near_dedup"](spark, table(spark, rows), "").collect()]
    assert sorted(kept, key=str) == sorted([(7, t) for t in texts] + [(None, "no id")], key=str)
