"""Sharpe statistics: standard error, probabilistic and deflated ratios, the luck threshold of many trials.

The scalar functions take per-observation figures. deflate() applies them to one aggregated row for each strategy.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwright.functions import normal

NORMAL = NormalDist()
EULER = 0.5772156649015329


def expected_max_sharpe(variance: float, trials: int) -> float:
    """Expected largest Sharpe ratio among `trials` of no skill; variance: of the ratios across trials."""
    if trials < 1 or variance < 0:
        raise ValueError("trials must be positive and the variance not negative")
    if trials == 1:
        return 0.0
    high, higher = NORMAL.inv_cdf(1 - 1 / trials), NORMAL.inv_cdf(1 - 1 / (trials * math.e))
    return math.sqrt(variance) * ((1 - EULER) * high + EULER * higher)


def sharpe_standard_error(sharpe: float, n: int, skew: float, kurtosis: float) -> float:
    """kurtosis: not in excess (3 for a normal)."""
    if n < 2 or kurtosis < 1:
        raise ValueError("n must be 2 at least and the kurtosis 1 at least")
    inside = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2
    if inside <= 0:
        raise ValueError("the variance of the Sharpe ratio is not positive")
    return math.sqrt(inside / (n - 1))


def probabilistic_sharpe(sharpe: float, threshold: float, n: int, skew: float, kurtosis: float) -> float:
    return NORMAL.cdf((sharpe - threshold) / sharpe_standard_error(sharpe, n, skew, kurtosis))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, variance: float, trials: int) -> float:
    return probabilistic_sharpe(sharpe, expected_max_sharpe(variance, trials), n, skew, kurtosis)


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One pass: n, mean, sd (ddof 1), sharpe, population skew and kurtosis (not in excess), share of zeros."""
    v = F.col(value)
    sums = df.where(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.skewness(v).alias("skew"), (F.kurtosis(v) + 3).alias("kurtosis"), F.avg((v == 0).cast("double")).alias("zero_share")
    )
    return sums.withColumn("sharpe", F.when(F.col("sd") >= 1e-12, F.col("mean") / F.col("sd")))


def deflate(stats: DataFrame, trials: int | None = None) -> DataFrame:
    """stats (of moments()) with threshold, psr (against 0) and dsr; one row for each strategy.

    The variance across strategies and their number are an aggregate of the same rows; trials may be given, to count
    those without a series too.
    """
    total = stats.agg(F.var_samp("sharpe").alias("v"), F.count("sharpe").alias("k")).first()
    threshold = expected_max_sharpe(float(total["v"] or 0.0), max(1, trials or int(total["k"])))
    inside = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") ** 2
    se = F.when((F.col("n") >= 2) & (F.col("kurtosis") >= 1) & (inside > 0), F.sqrt(inside / (F.col("n") - 1)))
    z = lambda t: F.try_divide(F.col("sharpe") - F.lit(t), se)
    return stats.withColumn("threshold", F.lit(threshold)).withColumn("psr", normal.cdf(z(0.0))).withColumn("dsr", normal.cdf(z(threshold)))
