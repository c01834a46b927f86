"""Performance metrics and purged cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAYS = 252
NOTHING = 1e-12


def equity_curve(returns: DataFrame, by: str = "strategy", value: str = "ret") -> DataFrame:
    """returns with equity (from 1), peak (1 at least) and drawdown (zero or below)."""
    order = W.partitionBy(by).orderBy("session_date").rowsBetween(W.unboundedPreceding, 0)
    out = returns.withColumn("equity", F.product(1 + F.col(value)).over(order))
    out = out.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(order)))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def summary(returns: DataFrame, by: str = "strategy", value: str = "ret") -> DataFrame:
    """n_sessions, annualised_return, annualised_volatility, sharpe_ratio, total_return, max_drawdown for each series.
    Series of fewer than two returns have no volatility and a ratio of 0, as those of negligible volatility."""
    curve = equity_curve(returns, by, value)
    sums = curve.groupBy(by).agg(
        F.count("*").alias("n_sessions"),
        (F.avg(value) * DAYS).alias("annualised_return"),
        F.coalesce(F.stddev_samp(value) * DAYS**0.5, F.lit(0.0)).alias("annualised_volatility"),
        (F.max_by("equity", "session_date") - 1).alias("total_return"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
    )
    sharpe = F.when(F.col("annualised_volatility") >= NOTHING, F.col("annualised_return") / F.col("annualised_volatility")).otherwise(F.lit(0.0))
    return sums.withColumn("sharpe_ratio", sharpe)


def tracking_error(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """strategy, tracking_error: annualised deviation of the difference on common sessions."""
    both = returns.join(benchmark.select("session_date", F.col("ret").alias("b")), "session_date")
    return both.groupBy("strategy").agg((F.stddev_samp(F.col("ret") - F.col("b")) * DAYS**0.5).alias("tracking_error"))


def purged_folds(spark: SparkSession, n: int, k: int, *, horizon: int, embargo: int) -> DataFrame:
    """fold, idx, role: contiguous test folds (the first n mod k have one more), and for each the training rows whose
    labels end before it or that start after its embargo."""
    if k < 2 or n < k:
        raise ValueError("k must be 2 at least and n not below k")
    size, more = divmod(n, k)
    starts = [f * size + min(f, more) for f in range(k + 1)]
    folds = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(a).alias("a"), F.lit(b - 1).alias("b")) for f, (a, b) in enumerate(zip(starts, starts[1:]))])).alias("f")
    rows = spark.range(n).select(F.col("id").cast("int").alias("idx"), folds).select("f.fold", "idx", "f.a", "f.b")
    role = F.when(F.col("idx").between(F.col("a"), F.col("b")), "test").when((F.col("idx") < F.col("a") - horizon) | (F.col("idx") > F.col("b") + embargo), "train")
    return rows.withColumn("role", role).where("role is not null").select("fold", "idx", "role")
