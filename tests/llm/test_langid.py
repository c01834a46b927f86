import zlib
from collections import Counter

import numpy as np

from pitwright.llm import langid, queries


def test_held_out_accuracy_and_split(spark, sample):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, sample).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def plain_profile(texts, most):
    counts = Counter()
    for text in texts:
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        if words:
            joined = " " + " ".join(words) + " "
            counts.update(joined[i : i + n] for n in (1, 2, 3) for i in range(len(joined) - n + 1))
    del counts[" "]
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [key(g) for g in sorted(counts, key=lambda g: (-counts[g], key(g)))[:most]]


def test_profiles_and_distances_equal_brute_force(spark):
    texts = {"en": ["The cat, the hat", "AND the Dog's"], "fr": ["le chat é là", "ÉTÉ"]}
    model = langid.train(spark.createDataFrame([(t, lang) for lang, ts in texts.items() for t in ts] + [(None, "en"), ("x", None), ("12", "de")], "text string, lang string"), profile=20)
    for lang, ts in texts.items():
        assert model[model.lang == lang].sort_values("place").code.tolist() == plain_profile(ts, 20)
    profiles = langid.Profiles(model, 20, 15)
    assert profiles.langs == ["en", "fr"]
    own = plain_profile(["the chat"], 15)
    want = [sum(abs(i - p.index(g)) if g in p else 20 for i, g in enumerate(own)) for p in (plain_profile(texts["en"], 20), plain_profile(texts["fr"], 20))]
    assert profiles.distances(np.array(own)).tolist() == want


def test_odd_rows(spark, odd, empty):
    model = langid.train(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred == ("en" if r.text and any(c.isalpha() for c in r.text) else "und") for r in rows)
    nothing = langid.train(empty)
    assert len(nothing) == 0 and {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
