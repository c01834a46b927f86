"""The strategy library over the daily panel, with the lookbacks that the names say, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwright.operators import calendar, strategies
from pitwright.plans.relational import ORACLES, QUERIES, r, sql
from pitwright.sources.panels import price_panel

__all__ = ["ORACLES", "QUERIES"]


#: Unit prices of line items are far from a normal distribution: no close lies two deviations below the mean, and gains
#: always outweigh losses. So these two look at their logarithms.
LOGARITHMS = ("bollinger_reversion", "rsi_oversold")


def _strategy(name: str):
    def run(spark, sf):
        panel = price_panel(spark, sf, "day").withColumn("adj_close", F.ln("close") if name in LOGARITHMS else F.col("close"))
        return strategies.weights(panel, calendar.build(panel), name).select("session_date", "symbol", r("weight", 9).alias("weight"))

    return run


FILLS = "nx AS (SELECT session_date, lead(session_date) OVER (ORDER BY session_date) AS fill FROM dcal), ret AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS ret FROM dy)"
EQUAL = "round(1.0 / count(*) OVER (PARTITION BY fill), 9) AS weight"


def frame(how: str, n: int) -> str:
    """An aggregate over the last n quotations; null where it is not full."""
    w = f"(PARTITION BY symbol ORDER BY session_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    value = how[how.index("(") + 1 : -1]
    return f"CASE WHEN count({value}) OVER {w} = {n} THEN {how} OVER {w} END"


def back(n: int) -> str:
    return f"close / lag(close, {n}) OVER (PARTITION BY symbol ORDER BY session_date) - 1"


def top(score: str, *, order: str = "DESC", where: str = "true", n: int = 10, source: str = "ret") -> str:
    return sql(f"SELECT fill AS session_date, symbol, {EQUAL} FROM (SELECT symbol, session_date, row_number() OVER (PARTITION BY session_date ORDER BY s {order}, symbol) AS k FROM (SELECT symbol, session_date, {score} AS s FROM {source}) WHERE s IS NOT NULL AND {where}) JOIN nx USING (session_date) WHERE k <= {n} AND fill IS NOT NULL", FILLS)


def among(score: str, condition: str, *, source: str = "ret") -> str:
    return sql(f"SELECT fill AS session_date, symbol, {EQUAL} FROM (SELECT *, avg(s) OVER (PARTITION BY session_date) AS mean_score FROM (SELECT symbol, session_date, {score} AS s FROM {source}) WHERE s IS NOT NULL) JOIN nx USING (session_date) WHERE {condition} AND fill IS NOT NULL", FILLS)


RANGE = "(SELECT *, (high - low) / close AS rel FROM dy)"
LOG_RISES = "(SELECT *, greatest(lr, 0.0) AS gain, greatest(-lr, 0.0) AS loss FROM (SELECT symbol, session_date, ln(close) / lag(ln(close)) OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS lr FROM dy))"
RISES = "(SELECT *, CASE WHEN ret > 0 THEN 1.0::DOUBLE WHEN ret <= 0 THEN 0.0::DOUBLE END AS rose FROM ret)"
VALUES = "(SELECT *, close * turnover_inr AS cv FROM dy)"
MACD = ", ".join(repr(w) for w in strategies.macd_weights(78, 12, 26, 9))
SD63 = frame("stddev_samp(ret)", 63)

STRATEGY_SQL = {
    "equal_weight_universe": among("0.0", "true"),
    "simple_momentum_63d": top(back(63)),
    "momentum_skip_month": top("lag(close, 21) OVER (PARTITION BY symbol ORDER BY session_date) / lag(close, 252) OVER (PARTITION BY symbol ORDER BY session_date) - 1"),
    "mean_reversion_5d": top(back(5), order="ASC"),
    "dual_momentum_21_126": among(f"CASE WHEN {back(21)} IS NOT NULL AND {back(126)} IS NOT NULL THEN least({back(21)}, {back(126)}) END", "s > 0"),
    "relative_strength_vs_universe": among(back(63), "s > mean_score"),
    "low_volatility": top(SD63, order="ASC", where="s > 0"),
    "high_volatility": top(SD63),
    "inverse_volatility_weighted": sql(f"SELECT fill AS session_date, symbol, round((1 / s) / sum(1 / s) OVER (PARTITION BY fill), 9) AS weight FROM (SELECT symbol, session_date, {SD63} AS s FROM ret) JOIN nx USING (session_date) WHERE s > 0 AND fill IS NOT NULL", FILLS),
    "min_drawdown": top(f"close / ({frame('max(close)', 126)}) - 1"),
    "breakout_20d": among(f"close - ({frame('max(close)', 20)})", "s >= 0"),
    "sma_crossover": among(f"({frame('avg(close)', 20)}) - ({frame('avg(close)', 50)})", "s > 0"),
    "long_term_reversal_756d": top(back(756), order="ASC"),
    "cross_sectional_zscore": top(back(21)),
    "equal_risk_contribution_pairs": sql(
        f"SELECT fill AS session_date, symbol, round(inv / n / sum(inv / n) OVER (PARTITION BY fill), 9) AS weight FROM (SELECT session_date, symbol, 1 / avg(s) OVER b AS inv, count(*) OVER b AS n FROM (SELECT *, s <= median(s) OVER (PARTITION BY session_date) AS low FROM (SELECT symbol, session_date, {SD63} AS s FROM ret) WHERE s > 0) WINDOW b AS (PARTITION BY session_date, low)) JOIN nx USING (session_date) WHERE fill IS NOT NULL", FILLS
    ),
    "donchian_channel": among(f"(close - ({frame('min(close)', 55)})) / nullif(({frame('max(close)', 55)}) - ({frame('min(close)', 55)}), 0)", "s >= 0.8"),
    "bollinger_reversion": among(f"lc - ({frame('avg(lc)', 20)}) + 2 * ({frame('stddev_samp(lc)', 20)})", "s < 0", source="(SELECT *, ln(close) AS lc FROM dy)"),
    "price_above_sma200": among(f"close - ({frame('avg(close)', 200)})", "s > 0"),
    "macd_signal_cross": among(f"CASE WHEN count(close) OVER w = 78 THEN list_dot_product(list(close) OVER w, [{MACD}]::DOUBLE[]) END", "s > 0", source="dy WINDOW w AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 77 PRECEDING AND CURRENT ROW)"),
    "rsi_oversold": among("CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) END", "s < 30", source=f"(SELECT symbol, session_date, {frame('avg(gain)', 14)} AS g, {frame('avg(loss)', 14)} AS l FROM {LOG_RISES})"),
    "price_vs_vwap": among(f"close - ({frame('sum(cv)', 63)}) / nullif(({frame('sum(turnover_inr)', 63)}), 0)", "s < 0", source=VALUES),
    "gap_fade": top("open / lag(close) OVER (PARTITION BY symbol ORDER BY session_date) - 1", order="ASC", where="s <= -0.02", n=5),
    "range_compression": top(f"({frame('avg(rel)', 10)}) / nullif(({frame('avg(rel)', 63)}), 0)", order="ASC", source=RANGE),
    "trend_persistence": top(frame("avg(rose)", 63), source=RISES),
    "volatility_breakout": among(f"({frame('stddev_samp(ret)', 21)}) - 1.25 * ({frame('stddev_samp(ret)', 126)})", "s > 0"),
    "turnover_growth": top(f"({frame('avg(turnover_inr)', 5)}) / nullif(({frame('median(turnover_inr)', 63)}), 0) - 1"),
    "equal_weight_top_liquidity": sql(f"SELECT fill AS session_date, symbol, {EQUAL} FROM (SELECT symbol, session_date, row_number() OVER (PARTITION BY session_date ORDER BY s DESC, symbol) AS k, count(*) OVER (PARTITION BY session_date) AS n FROM (SELECT symbol, session_date, {frame('median(turnover_inr)', 21)} AS s FROM dy) WHERE s IS NOT NULL) JOIN nx USING (session_date) WHERE k <= greatest(1, floor(n * 0.5)) AND fill IS NOT NULL", FILLS),
    "volume_weighted_momentum": top("own * liquid / max(liquid) OVER (PARTITION BY session_date)", source=f"(SELECT symbol, session_date, {back(63)} AS own, {frame('median(turnover_inr)', 63)} AS liquid FROM dy QUALIFY own IS NOT NULL AND liquid > 0)"),
    "seasonality_day_of_week": among("0.0", "isodow(session_date) IN (1, 2)"),
    "random_walk_baseline": top("md5(CAST(session_date AS VARCHAR) || '|' || symbol)"),
    "price_above_sma": among(f"close - ({frame('avg(close)', 50)})", "s > 0"),
    "liquidity_tilt": top(frame("avg(turnover_inr)", 21)),
}

for _name in strategies.STRATEGIES:
    QUERIES[f"s_{_name}"] = _strategy(_name)
    ORACLES[f"s_{_name}"] = STRATEGY_SQL[_name]
