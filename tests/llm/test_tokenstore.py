import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from pitwright.llm import queries, tokenstore

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_query_equals_whole_text_encoding(spark, sample):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sample}/documents.parquet").collect())
    start, want = 0, {}
    for (d, _), ids in zip(docs, plain_ids([t for _, t in docs])):
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_store(spark, sample).collect()}
    assert got == want


def test_words_equal_whole_texts():
    texts = ["don't STOP. I'LL go, 's x's", "É è́ Straße İ ΑΣ", "ÀÉÎÕÜ ÿ þÐ ß× ÷a ªº µm, Ångström. é", "tab\tnew\nline\r\x0b\x0c", "a b\x1cc　d", "<|endoftext|> hi", "<|startoftext|>", "a <|endoftext|> b", "x<|startoftext|>y<|ENDOFTEXT|>.<|endoftext|>", "é<|endoftext|>́ e", "x.y,z.. a., 12a 3.4", "́ lone", "w" * 500 + " w"]
    encoder = tokenstore.WordEncoder(PATH)
    assert [np.frombuffer(p, encoder.dtype).tolist() + [2] for p in encoder.encode(texts)] == plain_ids(texts)


def in_order(rows):
    """By key, null first, and the hash of the text."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, int(np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).view(np.int64))))


def test_a_key_over_several_shards(spark):
    rows = [(5, f"text {i}") for i in range(60)] + [(None, f"none {i}") for i in range(40)] + [(i, "w") for i in range(10)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    store = tokenstore.write_store(table, PATH, end_id=2, shards=9)
    assert sum(s["skip"] > 0 for s in store.manifest["shards"]) >= 3
    order = in_order(rows)
    want, start, seen = {}, 0, {}
    for (d, _), ids in zip(order, plain_ids([t for _, t in order])):
        seen[d] = seen.get(d, -1) + 1
        want[d, seen[d]] = (start, ids)
        start += len(ids)
    got = {(r.key, r.number): (r.start, np.frombuffer(r.ids, store.manifest["dtype"]).tolist()) for r in store.read(table).collect()}
    assert got == want
    assert store.read(spark.createDataFrame([(5,)] * 62, "doc_id bigint")).where("start is null").count() == 1


def test_odd_rows_and_strangers(spark, odd, empty):
    rows = in_order((r.doc_id, r.text or "") for r in odd.collect())
    want, start, seen = [], 0, {}
    for (d, _), ids in zip(rows, plain_ids([t for _, t in rows])):
        seen[d] = seen.get(d, -1) + 1
        want.append((d, seen[d], start, ids))
        start += len(ids)
    store = tokenstore.write_store(odd, PATH, end_id=2, shards=3)
    store = tokenstore.TokenStore.open(store.uri)
    got = [(r.key, r.number, r.start, np.frombuffer(r.ids, store.manifest["dtype"]).tolist()) for r in store.read(odd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    strangers = store.read(spark.createDataFrame([(77,), (-5,)], "doc_id bigint")).collect()
    assert [(r.start, r.ids) for r in strangers] == [(None, None)] * 2
    nothing = tokenstore.write_store(empty, PATH, end_id=2)
    assert nothing.manifest["shards"] == [] and nothing.read(empty).count() == 0
