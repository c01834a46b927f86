"""One query for each training-data operator, over its whole table, and the oracles that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, license, mixing, oracles, quality, simhash, spotsigs, suffix, tokenstore
from .common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.Tokenizer(spark, BYTE_BPE, public_tokenizers.PATTERN).encode_and_decode(docs, keep=["doc_id"])
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    planted = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id bigint, turn bigint, role string, text string")
    records = chat.gather(rows.unionByName(own))
    out = chat.format_turns(chat.canonical(records)).select("conv_id", "formatted", "loss_spans")
    read = out.withColumn("read", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("read").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.ledger(docs, keep=["doc_id"])
    base = F.lit(quality.mask_of(quality.BASE)).cast("bigint")
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"),
        quality.verdict().alias("kept"),
        "failed",
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license.scan(docs).select(
        "doc_id",
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("paragraph_sentences.id", ",").alias("paragraph_ids"),
        F.array_join("line_sentences.id", ",").alias("line_ids"),
        F.array_join(F.col("rules").cast("array<string>"), ",").alias("rules"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_documents(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix.remove_repeats(docs)
    return cut.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = tokenstore.write_store(docs, WORD_BPE, end_id=2)
    rows = store.read(docs.select("doc_id"), columns=("n_ids", "ids_crc32"))
    return rows.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = spotsigs.with_next(docs, lambda df: spotsigs.signatures(df, out_col="own"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("id", n.cast("bigint").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = spotsigs.signatures(rows, text_col="edited", out_col="edit")
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint("own").alias("fingerprint"),
        spotsigs.fingerprint("edit").alias("edited_fingerprint"),
        spotsigs.likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        spotsigs.likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_mixing": op6_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_simhash_links": op8_simhash_links,
    "op9_token_store": op9_token_store,
    "op10_spotsigs": op10_spotsigs,
}

#: SQL has no XXH64, packed ids, tokenizers, suffix arrays or fitted profiles: the other queries are tested against brute
#: force instead.
ORACLES: dict[str, str] = {
    "op3_chat_format": oracles.CHAT,
    "op5_license_scan": oracles.license_sql(),
    "op4_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, t FROM tri GROUP BY doc_id, t HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM tri JOIN again USING (doc_id, t)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (n_dup_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)::INT
  + 16 * (n_upper > n_lower)::INT + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 15 * n_words)::INT + 128 * (2 * n_digits > word_chars)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
""",
}
