"""Language identification by rank-order profiles.

A profile is a language's most frequent n-grams (1 to 3 characters) in order of frequency, counted over all training
texts. A document's most frequent n-grams are ranked alike; its out-of-place distance to a profile is the sum of the
differences of ranks, an n-gram that the profile lacks counting as far as can be. The nearest profile gives the
language; equal distances go to the first language in order of code points.

Texts are read as letters, lower-cased, with one space for each run of other characters. A null text, or one without a
letter, is `und` with score 0. The score is one minus the share of the largest possible distance. Texts are read
whole. Training rows with a null text or language are left out; without any profile all is `und`.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts, require_columns, slices

N = 3
PROFILE = 400
DOCUMENT = 300
#: Languages of a model. They are counted first and more are an error, so what the driver gets and what is broadcast stay
#: within languages * PROFILE n-grams.
LANGUAGES = 2000
_BITS = 21
_SPACE = 32
_FOLD: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point its lower case if it is a letter (of one character; else itself), or a space."""
    global _FOLD
    if _FOLD is None:
        table = np.full(sys.maxunicode + 1, _SPACE, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _FOLD = table
    return _FOLD


def letters(text: str) -> np.ndarray:
    """Folded letters with single spaces around and between words; empty without a letter."""
    points = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    space = points == _SPACE
    keep = ~(space & np.r_[True, space[:-1]]) if len(points) else space
    points = points[keep]
    if len(points) and points[-1] == _SPACE:
        points = points[:-1]
    return np.r_[_SPACE, points, _SPACE].astype(np.int64) if len(points) else points.astype(np.int64)


def ngrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of all n-grams of 1 to N characters but the single space; a code holds 21 bits a character."""
    codes, code = [points[points != _SPACE]], points
    for n in range(2, N + 1):
        code = (code[:-1] << _BITS) | points[n - 1 :]
        codes.append(code)
    return np.unique(np.concatenate(codes), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes in order, equals by code."""
    if len(codes) > 4 * most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:most]


def train(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> pd.DataFrame:
    """(lang, code, place) of the profiles. Every training text is counted; the driver gets profile rows a language.

    n-grams are summed in each batch and then by Spark; the most frequent of a language are taken in two steps, first
    within shares of the n-grams, so that no task sees all of a language.
    """
    require_columns(rows, text_col, lang_col)
    plain = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    if (found := plain.select("lang").distinct().count()) > LANGUAGES:
        raise ValueError(f"{found} languages; at most {LANGUAGES} can be learned")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                by: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    if len(points := letters(text)):
                        by.setdefault(lang, []).append(points)
                for lang, points in by.items():
                    each = [ngrams(p) for p in points]
                    codes, at = np.unique(np.concatenate([c for c, _ in each]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([n for _, n in each]), len(codes)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    sums = plain.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("code")]
    shares = sums.withColumn("share", F.pmod(F.xxhash64("code"), F.lit(64)))
    first = shares.withColumn("place", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= profile)
    best = first.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("place") <= profile)
    return best.select("lang", "code", "place").toPandas()


class Profiles:
    """Places of all profiles' n-grams, by language."""

    def __init__(self, rows: pd.DataFrame, profile: int = PROFILE, document: int = DOCUMENT):
        self.langs = sorted(rows["lang"].unique(), key=lambda s: s.encode())
        self.codes = np.unique(rows["code"].to_numpy(np.int64)) if len(rows) else np.zeros(0, np.int64)
        self.profile, self.document = profile, document
        self.places = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        for i, lang in enumerate(self.langs):
            own = rows[rows["lang"] == lang]
            self.places[i, np.searchsorted(self.codes, own["code"].to_numpy(np.int64))] = own["place"].to_numpy() - 1

    def distances(self, codes: np.ndarray) -> np.ndarray:
        """Out-of-place distance of ranked codes to each profile."""
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        places = self.places[:, np.where(self.codes[at] == codes, at, len(self.codes))]
        return np.where(places < 0, self.profile, np.abs(places - np.arange(len(codes)))).sum(axis=1)

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score, and margin to the next language as a share of the largest distance."""
        points = letters(text)
        if not len(points) or not self.langs:
            return "und", 0.0, 0.0
        codes = ranked(*ngrams(points), self.document)
        far = self.distances(codes) / (len(codes) * self.profile)
        best = int(np.argmin(far))
        rest = np.delete(far, best)
        return self.langs[best], float(max(0.0, 1 - far[best])), float(rest.min() - far[best]) if len(rest) else 1.0


def predict(df: DataFrame, model: pd.DataFrame, *, text_col: str = "text", keep: list[str] | None = None, profile: int = PROFILE, document: int = DOCUMENT) -> DataFrame:
    """The columns keep (None: all), lang_pred, score and margin. The model is broadcast; see LANGUAGES for its bound."""
    shared = df.sparkSession.sparkContext.broadcast(Profiles(model, profile, document))

    def kernel(texts: list[str]) -> list[tuple]:
        return list(zip(*map(shared.value.predict, texts)))

    return map_texts(df, kernel, [("lang_pred", "string"), ("score", "double"), ("margin", "double")], text_col=text_col, keep=keep)
