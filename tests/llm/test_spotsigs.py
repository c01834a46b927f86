import hashlib
import re

from pyspark.sql import functions as F

from pitwright.llm import queries, spotsigs

STOP = set(spotsigs.ANCHORS)


def plain_spots(text):
    """Signatures as word triples."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    out = set()
    for i, w in enumerate(words[:-1]):
        if w in STOP and words[i + 1] not in STOP:
            second = next((x for x in words[i + 2 : i + 3 + spotsigs.SKIP] if x not in STOP), "")
            out.add((w, words[i + 1], second))
    return out or ({tuple(p) for p in zip(words, words[1:])} or {(w,) for w in words} or ({text} if text else set()))


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(docs, got):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    sets = [plain_spots(t) for _, t in docs]
    want = []
    for i, (d, t) in enumerate(docs):
        j = (i + 1) % len(docs)
        n, k = len(t), len(t) // 2
        edited = t[: n - k] + docs[j][1][:k]
        want.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(sets[i], plain_spots(edited)), 9), round(jaccard(sets[i], sets[j]), 9)))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query_equals_brute_force(spark, sample):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sample}/documents.parquet").collect()]
    rows = queries.op10_spotsigs(spark, sample).collect()
    check(docs, [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows])
    text = dict(docs)
    by = {}
    for r in rows:
        assert by.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


def test_next_of_odd_rows(odd, empty):
    rows = spotsigs.with_next(odd, lambda df: df.withColumn("n", F.length("text")), buckets=5).collect()
    docs = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    want = [(d, t, docs[(i + 1) % len(docs)][1], len(docs[(i + 1) % len(docs)][1])) for i, (d, t) in enumerate(docs)]
    assert sorted([(r.id, r.text, r.next_text, r.next_n) for r in rows], key=str) == sorted(want, key=str)
    one = spotsigs.with_next(odd.where("doc_id = 4"), lambda df: df).collect()
    assert [(r.id, r.next_text) for r in one] == [(4, "")]
    assert spotsigs.with_next(empty, lambda df: df).count() == 0


def test_signatures_and_likeness(odd):
    rows = spotsigs.signatures(odd).select("text", spotsigs.fingerprint("signatures").alias("fp"), F.size("signatures").alias("n"), spotsigs.likeness(F.col("signatures"), F.array().cast("array<bigint>")).alias("empty")).collect()
    for r in rows:
        assert r.n == len(plain_spots(r.text or "")) and r.empty == (0.0 if r.n else 1.0)
    assert len({r.fp for r in rows if r.text and r.text.startswith("word")}) == 1


def test_similar_classes_lose_no_link(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text")
    table = spotsigs.signatures(docs)
    membership, links = spotsigs.similar_classes(table, threshold=0.6)
    sets = {r.doc_id: frozenset(r.signatures) for r in table.collect()}
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    assert {r.id: r.class_id for r in membership.collect()} == {d: first[s] for d, s in sets.items()}
    classes = sorted(first.values())
    want = {(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :] if jaccard(sets[a], sets[b]) >= 0.6 and (sets[a] or sets[b])}
    assert {(r.a, r.b) for r in links.collect()} == want
