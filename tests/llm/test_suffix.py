import hashlib
import random

import numpy as np
import pytest
import xxhash

from pitwright.llm import queries, suffix


def plain(docs, length):
    """{place in docs: (removed spans, kept bytes)}; docs are in order of precedence."""
    seen, out = set(), []
    for text in docs:
        covered = bytearray(len(text))
        for i in range(len(text) - length + 1):
            piece = text[i : i + length]
            if piece in seen:
                covered[i : i + length] = b"\x01" * length
            seen.add(piece)
        spans, i = [], 0
        while i < len(text):
            j = i
            while j < len(text) and covered[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = max(j, i + 1)
        out.append((spans, bytes(b for b, c in zip(text, covered) if not c)))
    return out


def test_query_equals_brute_force(spark, sample):
    docs = sorted((r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sample}/documents.parquet").collect())
    want = {d: (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for (d, t), (spans, kept) in zip(docs, plain([t for _, t in docs], 100))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, sample).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_odd_and_repetitive_rows(spark, odd, empty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rng = random.Random(5)
    base = "".join(rng.choice("ab é") for _ in range(400))
    rows += [(20 + i, base[rng.randrange(200) :][: rng.randrange(30, 200)] + "🎉" * rng.randrange(3) + base[: rng.randrange(150)]) for i in range(25)]
    rows += [(60, "ab" * 400), (61, "ba" * 300 + base), (62, "x" * 99), (63, "x" * 100)]
    table = spark.createDataFrame([(d, t, "kept", "spans") for d, t in rows], "doc_id bigint, text string, kept string, k string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).view(np.int64)))
    for length, hot in ((40, suffix.HOT), (100, suffix.HOT), (100, 10), (40, 0)):
        want = [(d, t, spans, kept) for (d, t), (spans, kept) in zip(order, plain([(t or "").encode() for _, t in order], length))]
        got = [(r.doc_id, r.text, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix.remove_repeats(table, length=length, hot=hot).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError, match="length"):
        suffix.remove_repeats(odd, length=5)


def test_suffixes_are_in_order_and_prefixes_right():
    rng = random.Random(3)
    for t in range(60):
        contexts = [bytes(rng.choice(b"ab\x00" if t % 2 else b"abcdefgh ") for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 8))]
        contexts += [rng.choice(contexts)[: rng.randrange(60)] + rng.choice(contexts)[:20] for _ in range(3)]
        length = rng.choice([4, 7, 12])
        data = np.r_[np.frombuffer(b"\xff".join(contexts), np.uint8), np.full(length + 16, 255, np.uint8)]
        order = suffix.two_stage_order(data, np.arange(len(data) - length - 16), length)
        raw = data.tobytes()
        pieces = [raw[i : i + length] for i in order.tolist()]
        assert pieces == sorted(pieces) and sorted(order.tolist()) == list(range(len(order)))
        prefixes = suffix.adjacent_prefixes(data, order, length)
        assert prefixes.tolist() == [0] + [next((k for k in range(length) if a[k] != b[k]), length) for a, b in zip(pieces, pieces[1:])]
        seen, want = set(), []
        for c in contexts:
            want.append([i for i in range(len(c) - length + 1) if c[i : i + length] in seen or seen.add(c[i : i + length])])
        assert [x.tolist() for x in suffix.repeats(contexts, length)] == want


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows = [(1, text), (2, text[1000:2500])]
    data = np.frombuffer(text.encode(), np.uint8)
    anchor, start, n = suffix.runs(data)
    assert n.sum() == len(text) - 99 and (np.diff(start) == n[:-1]).all()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: [], 2: [(0, 1500)]}
