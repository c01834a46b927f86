import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pitwright.llm import bpe, queries
from pitwright.llm.mph import MinimalPerfectHash

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_equal_the_library(ranks, plain):
    rng = random.Random(1)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    texts = ["", " ", "\n", " \n a", "a \n", "\x1c a\x1c", "don't  we'll 'S", "x" * 2000, "<|endoftext|>", "a\r\n b  "]
    texts += ["".join(rng.choice(" \n\tab1'!é \x1c中sZ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    packed = codec.encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [plain.encode_ordinary(t) for t in texts]
    assert codec.decode(packed) == [t.encode() for t in texts]


def test_memo_is_bounded(ranks, plain, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 8)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    for i in range(30):
        text = " ".join(f"word{i * j} {'y' * 70}{i}" for j in range(20))
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == plain.encode_ordinary(text)
    codec._trim()
    assert len(codec.pieces) <= 8 and len(codec.tokens) <= 16


def test_query_equals_the_library(spark, sample, plain):
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, sample).collect()}
    for r in spark.read.parquet(f"{sample}/documents.parquet").collect():
        ids = np.array(plain.encode_ordinary(r.text or ""), "<u4")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_rows(spark, odd, empty, plain):
    tokenizer = bpe.Tokenizer(spark, PATH, public_tokenizers.PATTERN)
    rows = tokenizer.encode_and_decode(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    assert tokenizer.decode(tokenizer.encode(odd), keep=["doc_id"]).count() == odd.count()
    assert tokenizer.encode(empty).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 2**64, 10_000, np.uint64)
    mph = MinimalPerfectHash.build(np.unique(keys))
    assert sorted(mph.lookup(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))
    again = MinimalPerfectHash.from_arrays(mph.to_arrays())
    assert (again.lookup(keys) == mph.lookup(keys)).all()
    with pytest.raises(ValueError, match="same"):
        MinimalPerfectHash.build(np.array([1, 1], np.uint64))
