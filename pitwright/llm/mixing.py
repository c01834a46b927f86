"""Mixing sources to target weights by entropy balancing.

Each document has a size in words and a source; each source gets a target of words. Among all document rates that meet
the targets, the ones nearest to the given prior rates in relative entropy (weighted by size) are exponentially
tilted, rate = prior * exp(lambda of the source), up to the largest rate. The lambdas solve the convex dual
sum over sources of (sum of size * prior * exp(lambda)) - lambda * target, by Newton steps that are sums over the
documents' cells (source and prior), distributed by source.

Rates are then rounded into whole copies: within a source and a bucket of document hashes, from the largest document
to the smallest, what one rounding leaves over is passed to the next document. So a bucket misses its target by about
half of its smallest documents, and no group larger than a bucket meets in one task. Documents of one id and size are
told apart by a hash of their texts (the column salt); what is equal in all of these shares a bucket.

A null text has size 0. A null source is a source of its own, the last. Documents of size 0 are taken once if the rate
of their source is at least one half. Repeated rows are documents of their own.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, require_columns

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Documents of a bucket on average; rounding takes a bucket at a time.
BUCKET = 1_000
TOLERANCE = 1e-10
MAX_STEPS = 60
#: Lambdas are sought between minus and plus this.
LIMIT = 50.0
#: A lambda whose exponential is 0.
NONE_AT_ALL = -1000.0
#: Sources up to which their rates are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def words(text_col: str = "text") -> Column:
    """Number of runs of other than space and U+0009 to U+000D; null: 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of sizes (source, size).

    Sources in order of code points, null last, have the weights in turn and share `share` of all sizes; no target is
    above `most` times its source's size, and what is over goes to the others by weight until none is above. That is
    target = least(most * source_size, level * weight) with one level for all: in order of the size at which sources
    are full, running sums give the level before each of them. One row for each source is sorted.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.asc_nulls_last(F.col("source").cast("binary")))) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("full") / F.col("weight"))
    everything = W.partitionBy()
    order = W.orderBy("ratio", F.asc_nulls_last("source"))
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The level before the first source that it does not fill is the level of all that are not full.
    with_level = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)["level"]
    target = F.least(F.col("full"), F.coalesce(final, F.lit(math.inf)) * F.col("weight"))
    return with_level.select("source", "source_size", target.alias("target"))


def balance(cells: DataFrame, targets: DataFrame, *, most: float = MOST) -> DataFrame:
    """(source, lambda) that meets the targets. cells: (source, prior, size), summed sizes of documents of one prior.

    A Newton step changes lambda by miss / slope. Where that leaves the bracket of lambdas known to take too little and
    too much (rates stop rising at `most`), the middle of the bracket is taken. A source that can take no more stops,
    and one with a target of 0 gets rates of 0. State is one row for each source, written each few steps.
    """
    now = targets.select("source", "target", F.lit(0.0).alias("lam"), F.lit(-LIMIT).alias("low"), F.lit(LIMIT).alias("high"), F.lit(False).alias("done"))
    for step in range(1, MAX_STEPS + 1):
        rate = F.col("prior") * F.exp("lam")
        free = F.when(rate < most, rate * F.col("size")).otherwise(0.0)
        sums = (
            cells.alias("c")
            .join(now.alias("n"), F.col("c.source").eqNullSafe(F.col("n.source")))
            .groupBy(F.col("n.source").alias("source"), "target", "lam", "low", "high", "done")
            .agg(F.sum(F.least(rate, F.lit(float(most))) * F.col("size")).alias("got"), F.sum(free).alias("slope"))
        )
        miss = F.col("target") - F.col("got")
        done = F.col("done") | (F.abs(miss) <= TOLERANCE * F.col("target")) | ((F.col("slope") <= 0) & (miss >= 0)) | (F.col("target") <= 0)
        low = F.when(miss > 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(miss < 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") + F.try_divide(miss, F.col("slope"))
        inside = (newton > low) & (newton < high)
        lam = F.when(F.col("target") <= 0, F.lit(NONE_AT_ALL)).when(done, F.col("lam")).when(inside, newton).otherwise((low + high) / 2)
        now = sums.select("source", "target", lam.alias("lam"), low.alias("low"), high.alias("high"), done.alias("done"))
        if step % 4 == 0:
            now = checkpointed(now)
            if not now.where("not done").limit(1).count():
                break
    return now.select("source", F.col("lam").alias("lambda"))


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of a bucket's documents, largest first, each rounding passing on what it leaves over."""
    pdf = pdf.sort_values(["size", "id", "salt"], ascending=[False, True, True], kind="stable")
    copies, left = [], 0.0
    for size, rate, most in zip(pdf["size"].tolist(), pdf["rate"].tolist(), pdf["most"].tolist()):
        if size <= 0:
            copies.append(int(rate >= 0.5))
            continue
        want = rate * size + left
        n = max(0, min(int(most), math.floor(want / size + 0.5)))
        left = want - n * size
        copies.append(n)
    return pdf.assign(copies=copies)[["id", "source", "size", "source_size", "target", "rate", "copies", "salt"]]


def mix(sizes: DataFrame, targets: DataFrame, *, most: float = MOST, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, salt) for each row of sizes (doc_id, source, size; prior
    if given, else 1; salt if given, else 0). targets: (source, source_size, target)."""
    require_columns(sizes, "doc_id", "source", "size")
    targets = checkpointed(targets)
    rows = sizes.select("doc_id", "source", "size", F.col("prior") if "prior" in sizes.columns else F.lit(1.0).alias("prior"), F.col("salt") if "salt" in sizes.columns else F.lit(0).cast("bigint").alias("salt"))
    cells = rows.groupBy("source", "prior").agg(F.sum("size").cast("double").alias("size"), F.count("*").alias("n"))
    cells = checkpointed(cells)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    counts = cells.groupBy("source").agg(F.sum("n").alias("n"))
    known = counts.alias("c").join(balance(cells, targets, most=most).alias("l"), same("c", "l"), "left").select("c.source", "n", "lambda")
    known = checkpointed(known.alias("k").join(targets.alias("t"), same("k", "t"), "left").select("k.source", "n", "lambda", "source_size", "target"))
    if known.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    tilted = rows.alias("r").join(known.alias("k"), same("r", "k"))
    rate = F.least(F.col("prior") * F.exp(F.coalesce("lambda", F.lit(0.0))), F.lit(float(most)))
    ready = tilted.select(
        F.col("doc_id").cast("string").alias("id"),
        "r.source",
        "size",
        "source_size",
        "target",
        rate.alias("rate"),
        F.lit(float(most)).alias("most"),
        "salt",
        F.pmod(F.xxhash64("doc_id", "size", "salt"), F.ceil(F.col("n") / bucket)).alias("bucket"),
    )
    schema = "id string, source string, size bigint, source_size bigint, target double, rate double, copies bigint, salt bigint"
    rounded = ready.groupBy("source", "bucket").applyInPandas(_round, schema)
    return rounded.withColumn("id", F.col("id").cast(sizes.schema["doc_id"].dataType)).withColumnRenamed("id", "doc_id")


def mix_documents(df: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """mix() of documents (doc_id, text, source) with source_targets()."""
    sizes = checkpointed(df.select("doc_id", "source", words().alias("size"), F.xxhash64("text").alias("salt")))
    return mix(sizes, source_targets(sizes, weights=weights, share=share, most=most), most=most)
