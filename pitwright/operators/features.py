"""Features of a panel that read only what was known: lags and trailing windows over a symbol's own quotations.

A trailing window is null until it holds enough values. Nothing here looks ahead; labels do, in labels.py.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.functions.checks import require_columns

MONTH, HALF_YEAR, YEAR = 21, 126, 252
FACTORS = ("momentum_12_1", "reversal_1m", "low_volatility", "illiquidity", "liquidity_size_proxy")


def by_symbol():
    return W.partitionBy("symbol").orderBy("session_date")


def lagged(column: str, n: int = 1) -> Column:
    return F.lag(column, n).over(by_symbol())


def trailing(column: str, window: int, how=F.avg, *, at_least: int | None = None, upto: int = -1) -> Column:
    """how() of the `window` quotations that end `-upto` before the row's own; null with fewer than at_least (all)
    values that are not null."""
    frame = by_symbol().rowsBetween(upto - window + 1, upto)
    return F.when(F.count(column).over(frame) >= (window if at_least is None else at_least), how(column).over(frame))


def ema(panel: DataFrame, alpha: float, price: str = "close") -> DataFrame:
    """symbol, session_date, ema: the recursion alpha * price + (1 - alpha) * the value before, from a symbol's first
    price on. A symbol's quotations are one group."""

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("session_date", kind="stable")
        return rows[["symbol", "session_date"]].assign(ema=rows[price].ewm(alpha=alpha, adjust=False).mean())

    return panel.select("symbol", "session_date", price).groupBy("symbol").applyInPandas(smooth, "symbol string, session_date date, ema double")


def with_returns(panel: DataFrame, price: str = "adj_close") -> DataFrame:
    return panel.withColumn("ret", F.try_divide(F.col(price), lagged(price)) - 1)


def daily_measures(panel: DataFrame, *, window: int = MONTH) -> DataFrame:
    """panel with ret, adv_inr (mean turnover of earlier quotations), abs_ret, rel_value and amihud_term."""
    require_columns(panel, "session_date", "symbol", "adj_close", "turnover_inr", "volume")
    value = F.col("turnover_inr")
    out = with_returns(panel).withColumn("adv_inr", trailing("turnover_inr", window))
    return out.withColumns({"abs_ret": F.abs("ret"), "rel_value": F.when(F.col("adv_inr") > 0, value / F.col("adv_inr")), "amihud_term": F.when(value > 0, F.abs("ret") / value)})


def factor_scores(panel: DataFrame, *, month: int = MONTH, half_year: int = HALF_YEAR, year: int = YEAR) -> DataFrame:
    """session_date, symbol, factor, score; a high score is what a book is long of. One sort by symbol serves all."""
    require_columns(panel, "session_date", "symbol", "adj_close", "turnover_inr")
    value = F.col("turnover_inr")
    staged = with_returns(panel).withColumn("cost_of_move", F.when(value > 0, F.abs("ret") / value))
    scores = {
        "momentum_12_1": F.try_divide(lagged("adj_close", month), lagged("adj_close", year)) - 1,
        "reversal_1m": -(F.try_divide(F.col("adj_close"), lagged("adj_close", month)) - 1),
        "low_volatility": -trailing("ret", half_year, F.stddev_samp),
        "illiquidity": trailing("cost_of_move", half_year, at_least=half_year // 2),
        "liquidity_size_proxy": -F.log1p(trailing("turnover_inr", half_year)),
    }
    wide = staged.select("session_date", "symbol", *[c.alias(n) for n, c in scores.items()])
    return wide.unpivot(["session_date", "symbol"], list(FACTORS), "factor", "score").where(F.col("score").isNotNull())


def long_short(scores: DataFrame, *, quantile: float = 0.2, least: int = 10) -> DataFrame:
    """session_date, factor, symbol, weight: equal weights of the top and bottom quantile of each cross-section, which
    sum to 1 and -1. Cross-sections of fewer than `least` names have no book. Equal scores rank by symbol."""
    if not 0 < quantile < 0.5:
        raise ValueError("the quantile must lie between 0 and 0.5")
    group = W.partitionBy("session_date", "factor")
    ranked = scores.withColumns({"rank": F.row_number().over(group.orderBy("score", "symbol")), "n": F.count("*").over(group)}).where(F.col("n") >= least)
    cut = F.ceil(F.col("n") * quantile)
    sided = ranked.withColumn("side", F.when(F.col("rank") > F.col("n") - cut, 1.0).when(F.col("rank") <= cut, -1.0)).where("side is not null")
    size = F.count("*").over(W.partitionBy("session_date", "factor", "side"))
    return sided.select("session_date", "factor", "symbol", (F.col("side") / size).alias("weight"))


def last_sessions(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the last n distinct sessions. The sessions are ranked on their own, few rows, and joined back."""
    days = panel.select("session_date").distinct()
    last = days.withColumn("r", F.row_number().over(W.orderBy(F.desc("session_date")))).where(F.col("r") <= n).drop("r")
    return panel.join(last, "session_date", "left_semi")


def view(panel: DataFrame, members: DataFrame, as_of: str, n: int = 0) -> DataFrame:
    """What a decision for the fill session as_of may see: rows before it of today's members (session_date, symbol), all
    of their past, also from when they were no members; of n > 0 the last n sessions that these rows have."""
    today = members.where(F.col("session_date") == F.lit(as_of).cast("date")).select("symbol").distinct()
    past = panel.where(F.col("session_date") < F.lit(as_of).cast("date")).join(today, "symbol", "left_semi")
    return last_sessions(past, n) if n > 0 else past
