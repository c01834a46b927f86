"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next one.

A stage gets what its predecessor kept, reads nothing else, and returns the columns of documents but for the last,
which returns the encoded corpus. Rows with null ids, null or empty texts and repeated rows pass as each operator's
docstring says; a table without rows gives one without rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.llm import bpe, mixing, nearcopy, quality, simhash, suffix
from pitwright.llm.common import checkpointed, fresh, shared_dir, table

#: Near duplicates take five words; fingerprints link at this many differing bits.
SHINGLE = 5
THRESHOLD = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.filter_quality(docs)


def _one_of_each(docs: DataFrame, *, verified: bool) -> DataFrame:
    """Of each group of linked documents the one with the smallest id (of equal ids, the text with the smallest hash). A
    document without an id stays only where its group has none with an id. verified: links by exact likeness join groups
    too. Only hashes are linked and grouped; the texts are shuffled once, to where the chosen ones are told."""
    names = docs.columns
    texts = docs.select("doc_id", "text", nearcopy.node(F.col("text")).alias("node"))
    if verified:
        marked = nearcopy.sketches(texts, shingle=SHINGLE, keep=["doc_id", "node"])
        sketched = [F.first(c).alias(c) for c in ("bands", "sketch")]
    else:
        marked = simhash.fingerprints(texts, shingle=SHINGLE, keep=["doc_id", "node"])
        sketched = []
    distinct = checkpointed(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), *sketched))
    # Texts of one fingerprint are linked to the least of them, and the links of fingerprints join these.
    least = checkpointed(distinct.groupBy("fp").agg(F.min("node").alias("v")))
    same = distinct.select("node", "fp").join(least, "fp").where("node != v").select(F.col("node").alias("u"), "v")
    found = simhash.links(least, threshold=THRESHOLD)
    ends = [least.select(F.col("fp").alias(c), F.col("v").alias(f"{c}_node")) for c in "uv"]
    edges = checkpointed(same.unionByName(found.join(ends[0], "u").join(ends[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))))
    if verified:
        edges = edges.unionByName(nearcopy.links(texts.select("node", "text"), distinct, edges, shingle=SHINGLE))
    groups = simhash.rooted(distinct.select("node", "first_id"), edges, key="node")
    key, number = fresh(docs, "key"), fresh(docs, "number")
    # Of one type on both sides: where only nullability differs, a cast would have the texts shuffled again for the join.
    kind = f"struct<node:bigint,doc_id:{docs.schema['doc_id'].dataType.simpleString()}>"
    # By node and id, so that the copies of one text are dealt to many tasks.
    best = F.min_by(F.struct("node", F.col("first_id").alias("doc_id")), F.struct(F.col("first_id").isNull(), "first_id", "node"))
    wanted = groups.groupBy("root").agg(best.alias(key)).select(F.col(key).cast(kind).alias(key))
    first = W.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    kept = docs.withColumn(key, F.struct(nearcopy.node(F.col("text")).alias("node"), "doc_id").cast(kind)).join(wanted, key)
    return kept.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).select(*names)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents whose fingerprints link at THRESHOLD bits."""
    return _one_of_each(docs, verified=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents whose fingerprints link at THRESHOLD bits, or whose texts have a Jaccard likeness
    of nearcopy.AT_LEAST or more on SHINGLE words."""
    return _one_of_each(docs, verified=True)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that start earlier too are cut out of the texts; all documents stay."""
    cut = suffix.remove_repeats(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows of one id, text and source are interchangeable: they share what
    the mix takes of them."""
    names = docs.columns
    key, number, share = (fresh(docs, c) for c in ("key", "number", "share"))
    kind = f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},salt:bigint,source:string>"  # see _one_of_each
    taken = mixing.mix_documents(docs).select(F.struct("doc_id", "salt", "source").cast(kind).alias(key), "copies")
    wanted = taken.groupBy(key).agg(F.struct(F.sum("copies").alias("copies"), F.count("*").alias("rows")).alias(share)).where(F.col(share)["copies"] > 0)
    placed = docs.withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("salt"), "source").cast(kind)).withColumn(number, F.row_number().over(W.partitionBy(key).orderBy(key)))
    copies, rows = F.col(share)["copies"], F.col(share)["rows"]
    times = F.expr(f"`{share}`.copies div `{share}`.rows") + F.when(F.col(number) <= copies % rows, 1).otherwise(0)
    found = placed.join(wanted, key).withColumn(share, times).where(F.col(share) > 0)
    return found.withColumn(number, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(share)))).select(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids (packed) and intact: whether decoding the ids gives the text."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    plain = docs.select("doc_id", "lang", "source", "n_chars", "text")
    out = tokenizer.encode_and_decode(plain)
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", "n_chars", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", whole.alias("intact"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe_encode", encode),
]

#: SQL expresses neither connected components nor encoding; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the shared folder and read by the next one."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
