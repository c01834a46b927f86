"""Strategies as expressions over what was visible before the fill session.

Every strategy turns a panel (session_date, symbol, adj_close, open, high, low, turnover_inr) of members into weights for the
session after the one that it looks at last; a name needs its whole lookback of own quotations. Ties go by symbol.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.operators.features import by_symbol, trailing, with_returns

TOP = 10
STRATEGIES = (
    "equal_weight_universe",
    "simple_momentum_63d",
    "momentum_skip_month",
    "mean_reversion_5d",
    "dual_momentum_21_126",
    "relative_strength_vs_universe",
    "low_volatility",
    "high_volatility",
    "inverse_volatility_weighted",
    "min_drawdown",
    "breakout_20d",
    "sma_crossover",
    "long_term_reversal_756d",
    "cross_sectional_zscore",
    "equal_risk_contribution_pairs",
    "donchian_channel",
    "bollinger_reversion",
    "price_above_sma200",
    "macd_signal_cross",
    "rsi_oversold",
    "price_vs_vwap",
    "gap_fade",
    "range_compression",
    "trend_persistence",
    "volatility_breakout",
    "turnover_growth",
    "equal_weight_top_liquidity",
    "volume_weighted_momentum",
    "seasonality_day_of_week",
    "random_walk_baseline",
    "price_above_sma",
    "liquidity_tilt",
)


def window_return(n: int, price: str = "adj_close") -> Column:
    return F.try_divide(F.col(price), F.lag(price, n).over(by_symbol())) - 1


def deviation(n: int) -> Column:
    return trailing("ret", n, F.stddev_samp, upto=0)


def highest(n: int, price: str = "adj_close") -> Column:
    return trailing(price, n, F.max, upto=0)


def lowest(n: int, price: str = "adj_close") -> Column:
    return trailing(price, n, F.min, upto=0)


def average(n: int, price: str = "adj_close") -> Column:
    return trailing(price, n, F.avg, upto=0)


def trailing_median(column: str, n: int) -> Column:
    """Median of the last n quotations; a frame has n values, so they are sorted in the row."""
    values = F.sort_array(F.collect_list(column).over(by_symbol().rowsBetween(-n + 1, 0)))
    middle = (F.element_at(values, (n + 1) // 2) + F.element_at(values, n // 2 + 1)) / 2
    return F.when(F.size(values) >= n, middle)


def macd_weights(n: int, fast: int, slow: int, signal: int) -> list[float]:
    """What each of the last n closes, oldest first, counts in the last difference of two exponential averages less the
    average of that difference, all seeded with their first value: averages are linear, so the whole is one sum."""

    def average(span: int) -> np.ndarray:
        a = 2.0 / (span + 1)
        out = np.zeros((n, n))
        out[0, 0] = 1.0
        for i in range(1, n):
            out[i] = (1 - a) * out[i - 1]
            out[i, i] += a
        return out

    line = average(fast) - average(slow)
    return (line - average(signal) @ line)[-1].tolist()


def macd(n: int = 78, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    closes = F.collect_list("adj_close").over(by_symbol().rowsBetween(-n + 1, 0))
    weights = F.array(*[F.lit(w) for w in macd_weights(n, fast, slow, signal)])
    return F.when(F.size(closes) >= n, F.aggregate(F.zip_with(closes, weights, lambda x, w: x * w), F.lit(0.0), lambda total, x: total + x))


def both(a: Column, b: Column) -> Column:
    """The smaller of two values; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def top(score: Column, *, n: int = TOP, largest: bool = True, where: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Equal weights of the n best-scored names of each session."""

    def build(rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("score", score).where(F.col("score").isNotNull())
        if where is not None:
            scored = scored.where(where)
        day = W.partitionBy("session_date")
        order = [F.desc("score") if largest else F.asc("score"), F.asc("symbol")]
        best = scored.withColumn("r", F.row_number().over(day.orderBy(*order))).where(F.col("r") <= n)
        return best.withColumn("weight", 1.0 / F.count("*").over(day))

    return build


def among(condition: Column, score: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Equal weights of the names for which the condition on the score holds."""

    def build(rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("score", F.lit(0.0) if score is None else score).where("score is not null").withColumn("mean_score", F.avg("score").over(W.partitionBy("session_date")))
        chosen = scored.where(condition)
        return chosen.withColumn("weight", 1.0 / F.count("*").over(W.partitionBy("session_date")))

    return build


def two_baskets(score: Column) -> Callable[[DataFrame], DataFrame]:
    """The names at or below the median score and those above it: each basket weighs inversely to its mean score, its
    names equally."""

    def build(rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("score", score).where("score > 0")
        middle = scored.groupBy("session_date").agg(F.median("score").alias("middle"))
        split = scored.join(middle, "session_date").withColumn("basket", F.col("score") <= F.col("middle"))
        basket, day = W.partitionBy("session_date", "basket"), W.partitionBy("session_date")
        sized = split.withColumns({"inv": 1 / F.avg("score").over(basket), "n": F.count("*").over(basket)})
        return sized.withColumn("weight", F.col("inv") / F.col("n") / F.sum(F.col("inv") / F.col("n")).over(day))

    return build


def top_share(score: Column, share: float) -> Callable[[DataFrame], DataFrame]:
    """Equal weights of a share of each session's names, one at least, by a score."""

    def build(rows: DataFrame) -> DataFrame:
        day = W.partitionBy("session_date")
        scored = rows.withColumn("score", score).where("score is not null")
        placed = scored.withColumns({"r": F.row_number().over(day.orderBy(F.desc("score"), "symbol")), "n": F.count("*").over(day)})
        best = placed.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)))
        return best.withColumn("weight", 1.0 / F.count("*").over(day))

    return build


def scaled_by_liquidity(score: Column, liquidity: Column) -> Callable[[DataFrame], DataFrame]:
    """top() by a score times a liquidity in proportion to the session's largest."""

    def build(rows: DataFrame) -> DataFrame:
        staged = rows.withColumns({"own": score, "liquid": liquidity}).where("own is not null and liquid > 0")
        return top(F.col("own") * F.col("liquid") / F.max("liquid").over(W.partitionBy("session_date")))(staged)

    return build


def inverse(score: Column) -> Callable[[DataFrame], DataFrame]:
    """Weights in proportion to one over a positive score."""

    def build(rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("score", score).where("score > 0").withColumn("inv", 1 / F.col("score"))
        return scored.withColumn("weight", F.col("inv") / F.sum("inv").over(W.partitionBy("session_date")))

    return build


def library() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Named strategies; lookbacks are in quotations of a name."""
    last, score = F.col("adj_close"), F.col("score")
    gains, losses = trailing("gain", 14, F.avg, upto=0), trailing("loss", 14, F.avg, upto=0)
    return {
        "equal_weight_universe": among(F.lit(True)),
        "simple_momentum_63d": top(window_return(63)),
        "momentum_skip_month": top(F.try_divide(F.lag("adj_close", 21).over(by_symbol()), F.lag("adj_close", 252).over(by_symbol())) - 1),
        "mean_reversion_5d": top(window_return(5), largest=False),
        "dual_momentum_21_126": among(score > 0, both(window_return(21), window_return(126))),
        "relative_strength_vs_universe": among(score > F.col("mean_score"), window_return(63)),
        "low_volatility": top(deviation(63), largest=False, where=score > 0),
        "high_volatility": top(deviation(63)),
        "inverse_volatility_weighted": inverse(deviation(63)),
        "min_drawdown": top(last / highest(126) - 1),
        "breakout_20d": among(score >= 0, last - highest(20)),
        "sma_crossover": among(score > 0, average(20) - average(50)),
        "long_term_reversal_756d": top(window_return(756), largest=False),
        "cross_sectional_zscore": top(window_return(21)),
        "equal_risk_contribution_pairs": two_baskets(deviation(63)),
        "donchian_channel": among(score >= 0.8, F.try_divide(last - lowest(55), highest(55) - lowest(55))),
        "bollinger_reversion": among(score < 0, last - average(20) + 2 * trailing("adj_close", 20, F.stddev_samp, upto=0)),
        "price_above_sma200": among(score > 0, last - average(200)),
        "macd_signal_cross": among(score > 0, macd()),
        "rsi_oversold": among(score < 30, 100 - 100 / (1 + gains / F.when(losses > 0, losses))),
        "price_vs_vwap": among(score < 0, last - F.try_divide(trailing("value_close", 63, F.sum, upto=0), trailing("turnover_inr", 63, F.sum, upto=0))),
        "gap_fade": top(F.try_divide(F.col("open"), F.lag("adj_close", 1).over(by_symbol())) - 1, n=5, largest=False, where=score <= -0.02),
        "range_compression": top(F.try_divide(trailing("rel_range", 10, F.avg, upto=0), trailing("rel_range", 63, F.avg, upto=0)), largest=False),
        "trend_persistence": top(trailing("rose", 63, F.avg, upto=0)),
        "volatility_breakout": among(score > 0, deviation(21) - 1.25 * deviation(126)),
        "turnover_growth": top(F.try_divide(trailing("turnover_inr", 5, F.avg, upto=0), trailing_median("turnover_inr", 63)) - 1),
        "equal_weight_top_liquidity": top_share(trailing_median("turnover_inr", 21), 0.5),
        "volume_weighted_momentum": scaled_by_liquidity(window_return(63), trailing_median("turnover_inr", 63)),
        "seasonality_day_of_week": among(F.weekday("session_date").isin(0, 1)),
        "random_walk_baseline": top(F.md5(F.concat_ws("|", F.col("session_date").cast("string"), "symbol"))),
        "price_above_sma": among(score > 0, last - average(50)),
        "liquidity_tilt": top(trailing("turnover_inr", 21, F.avg, upto=0)),
    }


def weights(panel: DataFrame, calendar: DataFrame, name: str) -> DataFrame:
    """strategy, session_date (of the fill), symbol, weight of a named strategy."""
    ret = F.col("ret")
    measures = {
        "rose": F.when(ret.isNotNull(), (ret > 0).cast("double")),
        "gain": F.when(ret.isNotNull(), F.greatest(ret, F.lit(0.0))),
        "loss": F.when(ret.isNotNull(), F.greatest(-ret, F.lit(0.0))),
        "value_close": F.col("adj_close") * F.col("turnover_inr"),
        "rel_range": F.try_divide(F.col("high") - F.col("low"), F.col("adj_close")),
    }
    rows = library()[name](with_returns(panel).withColumns(measures))
    fills = calendar.withColumn("fill", F.lead("session_date").over(W.orderBy("session_date"))).select("session_date", "fill")
    return rows.join(fills, "session_date").where("fill is not null").select(F.lit(name).alias("strategy"), F.col("fill").alias("session_date"), "symbol", "weight")
