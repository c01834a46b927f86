"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document: its measurements and a bit for each failed rule make a ledger row.
Policies are versioned sets of bits that are applied to the ledger later, without the texts; ablations (what a policy
would keep without one of its rules) are sums over the ledger's bitmasks.

A null text is an empty text: it has no words and fails too_few_words. Repeated rows each get their own ledger row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, require_columns

SPACE, SYMBOL, UPPER, LOWER, DIGIT, CONT, OTHER = range(7)


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[list(b"#*$%&|<>")] = SYMBOL
    kind[ord("A") : ord("Z") + 1] = UPPER
    kind[ord("a") : ord("z") + 1] = LOWER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[0x80:0xC0] = CONT
    return kind


CLASSES = _classes()
_BLANK = b" \t\n\r\x0b\x0c"

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, the first included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    again = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The MEASUREMENTS of a text; words are runs of other than space and U+0009 to U+000D."""
    raw = text.encode("utf-8", "surrogatepass")
    n = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=7).tolist() if raw else [0] * 7
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANK)]
    return (
        len(words),
        len(raw) - n[CONT] - n[SPACE],
        n[SYMBOL],
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        n[UPPER],
        n[LOWER],
        n[DIGIT],
    )


@dataclass(frozen=True)
class Rule:
    """bit: its place in the mask, never given to another rule. fails: from measurements to a boolean column."""

    bit: int
    name: str
    fails: Callable[[dict[str, Column]], Column]


RULES = (
    Rule(0, "too_few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule(2, "many_symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule(3, "repeated_lines", lambda m: (m["n_dup_lines"] >= 4) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
    Rule(4, "capitals", lambda m: m["n_upper"] > m["n_lower"]),
    Rule(5, "short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule(6, "long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
    Rule(7, "digits", lambda m: 2 * m["n_digits"] > m["word_chars"]),
)
BASE = ("too_few_words", "repeated_windows")
#: Versioned policies: names of the rules whose failure rejects a document.
POLICIES = {"base/1": BASE, "quality/1": (*BASE, "many_symbols", "repeated_lines", "capitals", "short_words", "long_words", "digits")}
POLICY = "quality/1"


def mask_of(names: tuple[str, ...]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def ledger(df: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (None: all) of df, the measurements and `failed`, the mask of failed rules."""

    def kernel(texts: list[str]) -> list[tuple]:
        return list(zip(*map(measure, texts)))

    measured = map_texts(df, kernel, [(m, "bigint") for m in MEASUREMENTS], text_col=text_col, keep=keep)
    m = {name: F.col(name) for name in MEASUREMENTS}
    failed = F.lit(0).cast("bigint")
    for r in RULES:
        failed = failed.bitwiseOR(F.when(r.fails(m), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("failed", failed)


def verdict(policy: str = POLICY) -> Column:
    """True for the ledger rows that the policy keeps."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("bigint")) == 0


def ablations(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that are kept without it.

    The ledger is first counted by mask, at most 2 ** rules of them, so the sums run over a few rows.
    """
    require_columns(rows, "failed")
    mask = mask_of(POLICIES[policy])
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")).alias("mask")).agg(F.count("*").alias("n"))
    own = [r for r in RULES if mask >> r.bit & 1]
    rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in own]))
    some = masks.select("mask", "n", rule.alias("r"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    return some.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("mask").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        total(F.col("mask") == F.col("r.bit")).alias("n_failed_alone"),
        total((F.col("mask") == 0) | (F.col("mask") == F.col("r.bit"))).alias("n_kept_without"),
    )


def filter_quality(df: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows of df that the policy keeps, with the columns of df."""
    names = df.columns
    work = df.toDF(*[f"c{i}" for i in range(len(names))])
    kept = ledger(work, text_col=f"c{names.index('text')}").where(verdict(policy))
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
