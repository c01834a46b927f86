"""Agreement, abstention, overfitting and duplicates."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.operators.frames import global_rank

MOST_PARTITIONS = 200_000


def confusion(pairs: DataFrame, categories: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """a, b, n for every pair of categories; unseen ones have 0."""
    spark = pairs.sparkSession
    each = [F.lit(c) for c in categories]
    grid = spark.range(1).select(F.explode(F.array(*each)).alias("a")).select("a", F.explode(F.array(*each)).alias("b"))
    seen = pairs.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    return grid.join(seen, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: n, agreement, chance, kappa (null where chance is 1 within 1e-12)."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(F.col("a").alias("c"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb")).unionByName(cells.select(F.col("b").alias("c"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb")))
    margins = sides.groupBy("c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("product"))
    totals = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    out = totals.crossJoin(margins).select("n", (F.col("same") / F.col("n")).alias("agreement"), (F.col("product") / F.col("n") / F.col("n")).alias("chance"))
    return out.withColumn("kappa", F.when(F.abs(1 - F.col("chance")) > 1e-12, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))))


def abstention_curve(scored: DataFrame, coverages: list[float], *, score: str = "score", value: str = "value", name: str = "name") -> DataFrame:
    """coverage, kept, performance: the mean value of the best-scored share, max(1, half-even round) of the names;
    equal scores by name."""
    n = scored.count()
    kept = [max(1, round(c * n)) for c in coverages]  # half to even
    cuts = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("coverage"), F.lit(k).alias("kept")) for c, k in zip(coverages, kept)])).alias("cut")
    best = global_rank(scored.select(score, name, value), F.desc(score), F.asc(name)).where(F.col("rank") <= max(kept, default=0))
    return best.select("rank", value, cuts).where("rank <= cut.kept").groupBy("cut.coverage", "cut.kept").agg(F.avg(value).alias("performance"))


def area(curve: DataFrame, x: str = "coverage", y: str = "performance") -> DataFrame:
    """area under the curve by trapezoids."""
    order = W.orderBy(x)
    step = (F.col(x) - F.lag(x).over(order)) * (F.col(y) + F.lag(y).over(order)) / 2
    return curve.select(step.alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("area"))


def overfitting(spark: SparkSession, returns: DataFrame, blocks: int = 16) -> DataFrame:
    """One row: partitions, pbo: the share of ways to split the blocks of sessions in halves in which the best strategy
    of one half ranks in the lower half of the other.

    returns: (strategy, idx, ret), idx from 0 without holes. Sums of blocks are aggregated first, so that a split adds
    up a few rows; ranks of equal ratios are averaged, and of equal winners the first by name counts.
    """
    if blocks % 2 or blocks < 2:
        raise ValueError("blocks must be even")
    if comb(blocks, blocks // 2) > MOST_PARTITIONS:
        raise ValueError(f"more than {MOST_PARTITIONS} partitions")
    size = F.broadcast(returns.agg((F.max("idx") + 1).alias("size")))  # one row
    block = F.least(F.floor(F.col("idx") * blocks / F.col("size")), F.lit(blocks - 1)).cast("int")
    sums = returns.join(size).withColumn("block", block).groupBy("strategy", "block").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    masks = spark.range(1 << blocks).where(F.bit_count("id") == blocks // 2).select(F.col("id").alias("split"), F.col("id").alias("mask"))
    cells = sums.crossJoin(F.broadcast(masks))
    inside = F.getbit("mask", F.col("block")) == 1

    def ratio(cond):
        k, s, q = (F.sum(F.when(cond, F.col(c))) for c in ("n", "s", "q"))
        var = (q - s * s / k) / (k - 1)
        return F.when((k > 1) & (var > 1e-24), s / k / F.sqrt(var)).otherwise(F.lit(0.0))

    scored = cells.groupBy("split", "strategy").agg(ratio(inside).alias("own"), ratio(~inside).alias("other"))
    group = W.partitionBy("split")
    low = F.rank().over(group.orderBy("other"))
    same = F.count("*").over(W.partitionBy("split", "other"))
    ranked = scored.withColumns({"rank": low + (same - 1) / 2, "n": F.count("*").over(group), "place": F.row_number().over(group.orderBy(F.desc("own"), "strategy"))})
    best = ranked.where("place = 1").withColumn("relative", F.col("rank") / (F.col("n") + 1))
    return best.agg(F.count("*").alias("partitions"), F.avg((F.col("relative") <= 0.5).cast("double")).alias("pbo"))


def exact_duplicates(series: DataFrame, *, digits: int = 12) -> DataFrame:
    """name, cluster (least name): series (name, session_date, ret) that are equal to that many digits. The rounded
    values are hashed in order, so no pair of series is compared; equal SHA-256 hashes are taken for equal series."""
    listed = series.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("session_date", F.round("ret", digits).alias("ret")))).alias("values"))
    signed = listed.withColumn("signature", F.sha2(F.to_json("values"), 256)).select("name", "signature")
    return signed.withColumn("cluster", F.min("name").over(W.partitionBy("signature"))).select("name", "cluster")


def correlations(series: DataFrame, *, at_least: int = 21) -> DataFrame:
    """a, b, correlation, n of all pairs of series on common sessions, a < b. The result itself has a row a pair; the
    join is by session."""
    a, b = (series.select("session_date", F.col("name").alias(x), F.col("ret").alias(f"r{x}")) for x in ("a", "b"))
    return a.join(b, "session_date").where("a < b").groupBy("a", "b").agg(F.corr("ra", "rb").alias("correlation"), F.count("*").alias("n")).where(F.col("n") >= at_least)


def spearman(df: DataFrame, a: str, b: str, name: str, *, averaged: bool = False) -> DataFrame:
    """One row: rank correlation; equal values rank by name, or share the mean rank."""

    def rank(c):
        if not averaged:
            return F.row_number().over(W.orderBy(c, name))
        return F.rank().over(W.orderBy(c)) + (F.count("*").over(W.partitionBy(c)) - 1) / 2

    return df.withColumns({"ra": rank(a), "rb": rank(b)}).agg(F.corr("ra", "rb").alias("spearman"), F.count("*").alias("n"))


def best_of_blocks(trials: DataFrame, k: int) -> DataFrame:
    """block, idx, score: the best of each k neighbouring trials, equals by the lowest idx; a block without scores has
    null."""
    best = F.max_by("idx", F.when(F.col("score").isNotNull(), F.struct("score", -F.col("idx"))))
    return trials.groupBy(F.floor(F.col("idx") / k).alias("block")).agg(best.alias("idx"), F.max("score").alias("score"))


def verify_ledger(lines: DataFrame) -> DataFrame:
    """seq, problem of a hash chain (seq, name, outcome, prev_hash, hash) where hash = sha256 of the others joined by a
    bar: gap, chain (prev_hash is not the hash before), hash (was changed), name (missing)."""
    order = W.orderBy("seq")
    staged = lines.withColumns({"before": F.coalesce(F.lag("hash").over(order), F.lit("")), "last": F.coalesce(F.lag("seq").over(order), F.lit(-1))})
    own = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), F.coalesce("name", F.lit("")), F.coalesce("outcome", F.lit("")), F.coalesce("prev_hash", F.lit(""))), 256)
    problems = F.array_compact(F.array(F.when(F.col("seq") != F.col("last") + 1, "gap"), F.when(~F.col("prev_hash").eqNullSafe(F.col("before")), "chain"), F.when(~F.col("hash").eqNullSafe(own), "hash"), F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name")))
    return staged.select("seq", F.explode(problems).alias("problem"))
