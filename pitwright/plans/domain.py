"""Domain operators as queries: factors, capacity, universes, costs, backtests, statistics, stress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.operators import adjust, backtest, calendar, capacity, costs, evaluate, features, labels, metrics, stress, universe
from pitwright.plans.relational import ORACLES, QUERIES, query, r, sql, week
from pitwright.sources.panels import event_panel, net_flow, price_panel, table

__all__ = ["ORACLES", "QUERIES"]

RET = "ret AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS ret FROM wk)"

#: Momentum of four weeks, books of the outer fifths, and returns of one week after a gap of one.
MOMENTUM = """
score AS (SELECT symbol, session_date, close / lag(close, 4) OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS score FROM wk),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY score, symbol) AS k, count(*) OVER (PARTITION BY session_date) AS n FROM score WHERE score IS NOT NULL),
sided AS (SELECT *, CASE WHEN k > n - ceil(n * 0.2) THEN 1.0 WHEN k <= ceil(n * 0.2) THEN -1.0 END AS side FROM ranked WHERE n >= 10),
book AS (SELECT session_date, symbol, side / count(*) OVER (PARTITION BY session_date, side) AS weight FROM sided WHERE side IS NOT NULL),
fwd AS (SELECT symbol, session_date, lead(close, 2) OVER w / lead(close, 1) OVER w - 1 AS fwd_1, lead(close, 5) OVER w / lead(close, 1) OVER w - 1 AS fwd_4, lead(close, 9) OVER w / lead(close, 1) OVER w - 1 AS fwd_8 FROM wk WINDOW w AS (PARTITION BY symbol ORDER BY session_date))
"""


def momentum_scores(panel: DataFrame) -> DataFrame:
    score = F.try_divide("adj_close", features.lagged("adj_close", 4)) - 1
    return panel.select("session_date", "symbol", F.lit("momentum").alias("factor"), score.alias("score")).where("score is not null")


def book(panel: DataFrame) -> DataFrame:
    return features.long_short(momentum_scores(panel), quantile=0.2)


@query("m0_factor_decay", sql("SELECT session_date, round(sum(weight * fwd_1), 6) AS book FROM book JOIN fwd USING (session_date, symbol) WHERE fwd_1 IS NOT NULL GROUP BY session_date", MOMENTUM))
def m0(spark: SparkSession, sf: str) -> DataFrame:
    panel = week(spark, sf)
    forward = labels.forward_returns(panel, (1,)).select("session_date", "symbol", "fwd_1").where("fwd_1 is not null")
    return book(panel).join(forward, ["session_date", "symbol"]).groupBy("session_date").agg(r(F.sum(F.col("weight") * F.col("fwd_1"))).alias("book"))


# Capacity and factors

MEASURES = f"""{RET},
meas AS (SELECT *, abs(ret) AS abs_ret, CASE WHEN count(turnover_inr) OVER b = 8 THEN avg(turnover_inr) OVER b END AS adv_inr, CASE WHEN turnover_inr > 0 THEN abs(ret) / turnover_inr END AS amihud FROM ret WINDOW b AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"""


@query("q01_daily_measures", sql("SELECT symbol, session_date, round(ret, 6) AS ret, round(adv_inr, 5) AS adv_inr, round(turnover_inr / adv_inr, 6) AS rel_value, round(amihud * 1e6, 6) AS amihud FROM meas", MEASURES))
def q01(spark, sf):
    m = features.daily_measures(week(spark, sf), window=8)
    return m.select("symbol", "session_date", r("ret").alias("ret"), r("adv_inr", 5).alias("adv_inr"), r("rel_value").alias("rel_value"), r(F.col("amihud_term") * 1e6).alias("amihud"))


@query(
    "q02_factor_scores",
    sql(
        """SELECT symbol, session_date, factor, round(score, 6) AS score FROM (
        SELECT symbol, session_date, lag(close, 4) OVER w / lag(close, 12) OVER w - 1 AS momentum_12_1, -(close / lag(close, 4) OVER w - 1) AS reversal_1m,
          CASE WHEN count(ret) OVER b = 8 THEN -stddev_samp(ret) OVER b END AS low_volatility,
          CASE WHEN count(cm) OVER b >= 4 THEN avg(cm) OVER b END AS illiquidity,
          CASE WHEN count(turnover_inr) OVER b = 8 THEN -ln(1 + avg(turnover_inr) OVER b) END AS liquidity_size_proxy
        FROM (SELECT *, CASE WHEN turnover_inr > 0 THEN abs(ret) / turnover_inr END AS cm FROM ret)
        WINDOW w AS (PARTITION BY symbol ORDER BY session_date), b AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
        UNPIVOT (score FOR factor IN (momentum_12_1, reversal_1m, low_volatility, illiquidity, liquidity_size_proxy))""",
        RET,
    ),
)
def q02(spark, sf):
    return features.factor_scores(week(spark, sf), month=4, half_year=8, year=12).select("symbol", "session_date", "factor", r("score").alias("score"))


@query("q03_long_short_book", sql("SELECT session_date, symbol, round(weight, 9) AS weight FROM book", MOMENTUM))
def q03(spark, sf):
    return book(week(spark, sf)).select("session_date", "symbol", r("weight", 9).alias("weight"))


@query("q04_forward_returns", sql("SELECT symbol, session_date, round(fwd_1, 6) AS fwd_1, round(fwd_4, 6) AS fwd_4 FROM fwd", MOMENTUM))
def q04(spark, sf):
    return labels.forward_returns(week(spark, sf), (1, 4)).select("symbol", "session_date", r("fwd_1").alias("fwd_1"), r("fwd_4").alias("fwd_4"))


DECAY = MOMENTUM + """, long AS (SELECT h, session_date, sum(weight * f) / h AS b FROM book JOIN (SELECT symbol, session_date, 1 AS h, fwd_1 AS f FROM fwd UNION ALL SELECT symbol, session_date, 4, fwd_4 FROM fwd UNION ALL SELECT symbol, session_date, 8, fwd_8 FROM fwd) USING (session_date, symbol) WHERE f IS NOT NULL GROUP BY h, session_date),
curve AS (SELECT CAST(h AS INT) AS horizon, avg(b) AS m, stddev_samp(b) AS sd, count(*) AS n, greatest(count(*) // h, 1) AS ind FROM long GROUP BY h)"""


def curve(spark, sf):
    panel = week(spark, sf)
    return capacity.decay_curve(book(panel), labels.forward_returns(panel, (1, 4, 8)), (1, 4, 8))


@query("q05_decay_curve", sql("SELECT horizon, round(m, 6) AS mean, round(sd / sqrt(ind), 6) AS error, n, ind AS n_independent FROM curve", DECAY))
def q05(spark, sf):
    return curve(spark, sf).select("horizon", r("mean_per_session").alias("mean"), r("standard_error").alias("error"), "n", "n_independent")


@query("q06_half_life", sql("SELECT 'momentum' AS factor, min(horizon) FILTER (WHERE horizon > 1 AND (SELECT m FROM curve WHERE horizon = 1) > 0 AND m <= (SELECT m FROM curve WHERE horizon = 1) / 2) AS half_life FROM curve", DECAY))
def q06(spark, sf):
    return capacity.half_life(curve(spark, sf))


CAPACITY = MOMENTUM + f""", {MEASURES},
days AS (SELECT session_date, lead(session_date) OVER (ORDER BY session_date) AS nxt FROM (SELECT DISTINCT session_date FROM book)),
prev AS (SELECT nxt AS session_date, symbol, weight FROM book JOIN days USING (session_date) WHERE nxt IS NOT NULL),
traded AS (SELECT * FROM (SELECT coalesce(a.session_date, b.session_date) AS session_date, coalesce(a.symbol, b.symbol) AS symbol, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS frac FROM book a FULL JOIN prev b ON a.session_date = b.session_date AND a.symbol = b.symbol) WHERE frac > 1e-9),
named AS (SELECT t.session_date, t.symbol, 0.01 * adv_inr / frac AS cap, row_number() OVER (PARTITION BY t.session_date ORDER BY 0.01 * adv_inr / frac, t.symbol) AS k FROM traded t JOIN meas m ON t.session_date = m.session_date AND t.symbol = m.symbol WHERE adv_inr > 0),
percap AS (SELECT session_date, max(cap) FILTER (WHERE k = 1) AS capacity, max(symbol) FILTER (WHERE k = 1) AS binding, count(*) AS n, max(cap) FILTER (WHERE k = 2) AS second FROM named GROUP BY 1)"""


def per_session(spark, sf):
    panel = week(spark, sf)
    traded = capacity.turnover_by_session(book(panel), at_least=1e-9)
    return capacity.session_capacity(traded, features.daily_measures(panel, window=8), participation=0.01)


@query("q07_turnover", sql("SELECT session_date, symbol, round(frac, 9) AS traded FROM traded", CAPACITY))
def q07(spark, sf):
    return capacity.turnover_by_session(book(week(spark, sf)), at_least=1e-9).select("session_date", "symbol", r("traded_fraction", 9).alias("traded"))


@query("q08_session_capacity", sql("SELECT session_date, round(capacity, 8) AS capacity, binding, n, round(second, 8) AS second FROM percap", CAPACITY))
def q08(spark, sf):
    return per_session(spark, sf).select("session_date", r("capacity_inr", 8).alias("capacity"), F.col("binding_symbol").alias("binding"), F.col("n_names").alias("n"), r("second_capacity", 8).alias("second"))


@query("q09_capacity_summary", sql("SELECT round(min(capacity), 8) AS binding, round(min_by(capacity, session_date), 8) AS entry, round(median(capacity), 8) AS median, round(quantile_cont(capacity, 0.05), 8) AS p05, round(quantile_cont(capacity, 0.95), 8) AS p95, count(*) AS n, round(avg(CASE WHEN second > 2 * capacity THEN 1.0 ELSE 0.0 END), 6) AS one_name, round(median(second), 8) AS relaxed FROM percap", CAPACITY))
def q09(spark, sf):
    s = capacity.summarise_capacity(per_session(spark, sf))
    names = {"binding_capacity": "binding", "entry_capacity": "entry", "median_capacity": "median", "p05_capacity": "p05", "p95_capacity": "p95", "median_relaxed": "relaxed"}
    return s.select(*[r(a, 8).alias(b) for a, b in names.items()], F.col("n_sessions").alias("n"), r("bound_by_one_name").alias("one_name"))


FLOW = """roll AS (SELECT session_date, net, CASE WHEN count(net) OVER w = 3 THEN sum(net) OVER w END AS rolling FROM net WINDOW w AS (ORDER BY session_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
based AS (SELECT *, CASE WHEN count(rolling) OVER w = 10 THEN avg(rolling) OVER w END AS m, CASE WHEN count(rolling) OVER w = 10 THEN stddev_samp(rolling) OVER w END AS sd FROM roll WINDOW w AS (ORDER BY session_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
zed AS (SELECT session_date, CASE WHEN sd > 0 THEN (rolling - m) / sd END AS z FROM based)"""


@query("q12_flow_state", sql("SELECT session_date, round(z, 6) AS z, CASE WHEN z IS NULL THEN NULL WHEN z >= 1 THEN 'inflow' WHEN z <= -1 THEN 'outflow' ELSE 'neutral' END AS flow_state FROM zed", FLOW))
def q12(spark, sf):
    return capacity.flow_states(net_flow(spark, sf), window=3, baseline=10).select("session_date", r("z").alias("z"), "flow_state")


@query("q14_elasticity", sql("SELECT symbol, round(regr_slope(y, x), 6) AS delta, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r_squared, count(*) AS n FROM (SELECT symbol, ln(abs_ret) AS y, ln(turnover_inr / adv_inr) AS x FROM meas WHERE abs_ret > 0 AND adv_inr > 0 AND turnover_inr > 0) GROUP BY symbol HAVING count(*) >= 50", MEASURES))
def q14(spark, sf):
    return capacity.elasticity(features.daily_measures(week(spark, sf), window=8), min_sessions=50).select("symbol", r("delta").alias("delta"), r("intercept").alias("intercept"), r("r_squared").alias("r_squared"), "n")


@query("e13_slope_errors", sql("SELECT symbol, round(regr_slope(ret, x), 6) AS slope, round(sqrt((regr_syy(ret, x) - regr_sxy(ret, x) ** 2 / regr_sxx(ret, x)) / (count(*) - 2) / regr_sxx(ret, x)), 6) AS error, count(*) AS n FROM (SELECT symbol, ret, turnover_inr / adv_inr AS x FROM meas) WHERE ret IS NOT NULL AND x IS NOT NULL GROUP BY symbol HAVING count(*) > 2", MEASURES))
def e13(spark, sf):
    m = features.daily_measures(week(spark, sf), window=8)
    return capacity.slopes(m, ["symbol"], "ret", "rel_value").where("n > 2").select("symbol", r("slope").alias("slope"), r("standard_error").alias("error"), "n")


# Universe and data quality

UNIVERSE = """reb AS (SELECT min(session_date) AS rebalance_date FROM cal GROUP BY date_trunc('quarter', session_date)),
rebi AS (SELECT rebalance_date, session_idx AS pos FROM reb JOIN cal ON session_date = rebalance_date WHERE session_idx > 0),
win AS (SELECT rebalance_date, session_date FROM rebi JOIN cal ON session_idx BETWEEN pos - 12 AND pos - 1),
liq AS (SELECT rebalance_date, symbol, median(turnover_inr) AS m, count(*) AS traded FROM win JOIN wk USING (session_date) GROUP BY 1, 2),
elig AS (SELECT liq.*, row_number() OVER (PARTITION BY rebalance_date ORDER BY m DESC, symbol) AS rank FROM liq JOIN (SELECT rebalance_date, count(*) AS w FROM win GROUP BY 1) USING (rebalance_date) WHERE traded >= greatest(4 * 0.5, w * 0.5))"""


def ranks(spark, sf):
    panel = week(spark, sf)
    cal = calendar.build(panel)
    return universe.ranked(universe.liquidity(panel, cal, calendar.rebalance_dates(cal), trailing=12), min_listed=4, fraction=0.5)


@query("d03_liquidity_ranks", sql("SELECT rebalance_date, symbol, round(m, 4) AS median_turnover, traded, CAST(rank AS INT) AS rank FROM elig", UNIVERSE))
def d03(spark, sf):
    return ranks(spark, sf).select("rebalance_date", "symbol", r("median_turnover", 4).alias("median_turnover"), F.col("sessions_traded").alias("traded"), "rank")


@query("d04_universe_select", sql("SELECT rebalance_date, symbol, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rebalance_date ORDER BY CASE WHEN inc AND rank <= 10 THEN 0 WHEN NOT inc AND rank <= 5 THEN 1 ELSE 2 END, rank) AS place FROM (SELECT elig.*, symbol IN (SELECT symbol FROM elig e WHERE e.rank <= 8 AND e.rebalance_date = (SELECT min(rebalance_date) FROM elig)) AS inc FROM elig)) WHERE place <= 8", UNIVERSE))
def d04(spark, sf):
    all_ranks = ranks(spark, sf)
    first = all_ranks.agg(F.min("rebalance_date").alias("rebalance_date"))
    held = all_ranks.where("rank <= 8").join(first, "rebalance_date", "left_semi")
    return universe.select(all_ranks, held, size=8, entry=5, exit=10)


@query("d07_detect_adjustments", sql("SELECT symbol, session_date AS ex_date, round(f, 6) AS factor FROM (SELECT symbol, session_date, lag(close) OVER w / open AS f, session_idx - lag(session_idx) OVER w = 1 AS adj FROM dy JOIN dcal USING (session_date) WINDOW w AS (PARTITION BY symbol ORDER BY session_date)) WHERE adj AND (f > 1.05 OR f < 1 / 1.05)"))
def d07(spark, sf):
    panel = price_panel(spark, sf, "day").withColumn("prev_close", F.col("open"))
    return adjust.detect(panel, calendar.build(panel)).select("symbol", "ex_date", r("factor").alias("factor"))


@query("d11_back_adjust", sql("SELECT w.symbol, w.session_date, round(close / d, 10) AS adj_close, d AS divisor FROM (SELECT wk.*, coalesce((SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE 2.0 ** count(*) END FROM ex WHERE ex.symbol = wk.symbol AND ex.ex_date > wk.session_date), 1.0) AS d FROM wk) w", "ex AS (SELECT symbol, max(session_date) AS ex_date FROM wk WHERE session_date < DATE '1995-01-01' GROUP BY 1 UNION ALL SELECT symbol, max(session_date) FROM wk WHERE session_date < DATE '1997-01-01' GROUP BY 1)"))
def d11(spark, sf):
    panel = week(spark, sf)
    days = [panel.where(f"session_date < '{y}-01-01'").groupBy("symbol").agg(F.max("session_date").alias("ex_date")) for y in (1995, 1997)]
    events = days[0].unionByName(days[1]).withColumn("factor", F.lit(2.0))
    return adjust.back_adjust(panel, events).select("symbol", "session_date", r("adj_close", 10).alias("adj_close"), "divisor")


@query("d12_unexplained_moves", sql("SELECT symbol, session_date, round(ratio, 6) AS ratio FROM (SELECT symbol, session_date, close / lag(close) OVER w AS ratio, session_idx - lag(session_idx) OVER w = 1 AS adj FROM wk JOIN cal USING (session_date) WINDOW w AS (PARTITION BY symbol ORDER BY session_date)) WHERE adj AND ratio < 0.65 AND NOT (symbol = 'Brand#11')"))
def d12(spark, sf):
    panel = week(spark, sf)
    known = panel.where("symbol = 'Brand#11'").select("symbol", F.col("session_date").alias("ex_date"))
    return adjust.unexplained_moves(panel, calendar.build(panel), known).select("symbol", "session_date", r("ratio").alias("ratio"))


@query("d06_cross_check", sql("SELECT count(*) AS compared, count(*) FILTER (WHERE abs(w.close / d.close - 1) > 0.005) AS mismatched, round(count(*) FILTER (WHERE abs(w.close / d.close - 1) > 0.005) / count(*), 6) AS rate FROM wk w JOIN dy d ON w.symbol = d.symbol AND w.session_date = d.session_date WHERE d.close > 0"))
def d06(spark, sf):
    rate, _ = adjust.cross_check(week(spark, sf), price_panel(spark, sf, "day"))
    return rate.withColumn("rate", r("rate"))


@query("x02_artifact_free_panel", sql("SELECT symbol, session_date FROM wk WHERE NOT (symbol = 'Brand#12' AND session_date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31')"))
def x02(spark, sf):
    flags = spark.createDataFrame([("Brand#12", "1995-01-01", "1995-12-31", "test")], "symbol string, a string, b string, reason string").select("symbol", F.to_date("a").alias("start_date"), F.to_date("b").alias("end_date"), "reason")
    return adjust.without_flagged(week(spark, sf), flags).select("symbol", "session_date")


# Costs

COSTS = """legs AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10000 AS day, o_totalprice AS t, o_orderkey % 2 = 0 AS sells, o_totalprice * (1 + o_orderkey % 50) AS v FROM orders),
rated AS (SELECT *, CASE WHEN day >= DATE '2024-10-01' THEN 0.0000297 WHEN day >= DATE '2024-04-01' THEN 0.0000322 ELSE 0.0000325 END AS x FROM legs WHERE day >= DATE '2015-01-01')"""


def legs(spark, sf):
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    rows = table(spark, sf, "orders").select(k, F.date_add(F.to_date("o_orderdate"), 10000).alias("on"), t.alias("turnover"), F.when(k % 2 == 0, "sell").otherwise("buy").alias("side"), (t * (1 + k % 50)).alias("traded_value"), F.when(k % 2 == 0, 1).otherwise(0).alias("scrips"))
    return rows.where("on >= '2015-01-01'")


@query("b13_statutory_charges", sql("SELECT o_orderkey, round(t * 0.001, 10) AS stt, round(CASE WHEN sells THEN 0 ELSE t * 0.00015 END, 10) AS stamp, round(t * x, 10) AS exchange, round(t * (x + 0.000002) * 0.18, 10) AS gst, round(t * 0.001 + CASE WHEN sells THEN 15.34 ELSE t * 0.00015 END + t * (x + 0.000002) * 1.18, 10) AS total FROM rated", COSTS))
def b13(spark, sf):
    s = costs.execute(legs(spark, sf), depository=costs.DEPOSITORY)
    return s.select("o_orderkey", *[r(f"statutory.{c}", 10).alias(c) for c in ("stt", "stamp", "exchange", "gst")], r("statutory.total", 10).alias("total"))


@query("b16_execution_cost", sql("SELECT o_orderkey, round(t * least(0.1 * t / v, 0.05), 8) AS slippage, round(t * 0.02 * sqrt(t / v), 8) AS impact FROM rated", COSTS))
def b16(spark, sf):
    return costs.execute(legs(spark, sf)).select("o_orderkey", r("slippage", 8).alias("slippage"), r("impact", 8).alias("impact"))


@query("b18_order_audit", sql("SELECT o_orderkey, CASE WHEN t > 0.03 * v THEN 1 ELSE 0 END AS participation, CASE WHEN v < 200000 THEN 1 ELSE 0 END AS liquidity FROM rated", COSTS))
def b18(spark, sf):
    rows = legs(spark, sf).withColumns({"adv": F.col("traded_value"), "fill": F.lit(1.0), "previous": F.lit(1.0)})
    out = costs.audit_orders(rows, participation=0.03, min_adv=200_000.0)
    has = lambda n: F.array_contains("violations", n).cast("int").alias(n)
    return out.select("o_orderkey", has("participation"), has("liquidity"))


# Backtests

GROSS = MOMENTUM + """,
fills AS (SELECT session_date, lead(session_date) OVER (ORDER BY session_date) AS fill FROM cal),
tgt AS (SELECT fill AS session_date, symbol, weight / 2 AS weight FROM book JOIN fills USING (session_date) WHERE fill IS NOT NULL),
steps AS (SELECT session_date, lead(session_date) OVER (ORDER BY session_date) AS nxt FROM (SELECT DISTINCT session_date FROM tgt)),
pre AS (SELECT nxt AS session_date, symbol, weight AS p FROM tgt JOIN steps USING (session_date) WHERE nxt IS NOT NULL),
mv AS (SELECT coalesce(t.session_date, p.session_date) AS session_date, coalesce(t.symbol, p.symbol) AS symbol, coalesce(weight, 0) AS w, coalesce(p, 0) AS p, t.symbol IS NOT NULL AS held FROM tgt t FULL JOIN pre p ON t.session_date = p.session_date AND t.symbol = p.symbol),
pc AS (SELECT a.symbol, a.session_date, a.open, a.close, b.close AS pclose FROM (SELECT wk.*, session_idx FROM wk JOIN cal USING (session_date)) a LEFT JOIN (SELECT wk.*, session_idx FROM wk JOIN cal USING (session_date)) b ON a.symbol = b.symbol AND a.session_idx = b.session_idx + 1),
acc AS (SELECT mv.*, open, close, pclose, CASE WHEN pclose > 0 AND w * p > 0 THEN CASE WHEN w >= 0 THEN least(p, w) ELSE greatest(p, w) END ELSE 0 END AS carried FROM mv LEFT JOIN pc ON mv.symbol = pc.symbol AND mv.session_date = pc.session_date),
gross AS (SELECT session_date, sum(CASE WHEN held AND open > 0 AND close <> 0 THEN coalesce(carried * (close / pclose - 1), 0) + (w - carried) * (close / open - 1) ELSE 0 END) AS g, sum(abs(w)) AS x, sum(abs(w - p)) AS t FROM acc GROUP BY 1)"""


def momentum_run(spark, sf):
    panel = week(spark, sf)
    cal = calendar.build(panel)
    fills = cal.withColumn("fill", F.lead("session_date").over(W.orderBy("session_date"))).where("fill is not null").select("session_date", "fill")
    weights = book(panel).join(fills, "session_date").select(F.lit("momentum").alias("strategy"), F.col("fill").alias("session_date"), "symbol", (F.col("weight") / 2).alias("weight"))
    return weights, weights.select("strategy", "session_date").distinct(), panel, cal


@query("b06_gross_backtest", sql("SELECT session_date, round(g, 6) AS gross_return, round(x, 6) AS gross_exposure, round(t, 6) AS turnover FROM gross", GROSS))
def b06(spark, sf):
    return backtest.gross(*momentum_run(spark, sf)).select("session_date", r("gross_return").alias("gross_return"), r("gross_exposure").alias("gross_exposure"), r("turnover").alias("turnover"))


@query("b04_clamp", sql("SELECT session_date, symbol, round(CASE WHEN g > 1 THEN weight / g ELSE weight END, 9) AS weight FROM (SELECT *, sum(abs(weight)) OVER (PARTITION BY session_date) AS g FROM book WHERE symbol <> 'Brand#13')", MOMENTUM))
def b04(spark, sf):
    panel = week(spark, sf)
    weights = book(panel).withColumn("strategy", F.lit("momentum"))
    return backtest.clamp(weights, panel.where("symbol != 'Brand#13'")).select("session_date", "symbol", r("weight", 9).alias("weight"))


@query("b19_metrics", sql("SELECT symbol, count(*) AS n_sessions, round(avg(x) * 252, 6) AS annualised_return, round(stddev_samp(x) * sqrt(252), 6) AS annualised_volatility, round(avg(x) * 252 / (stddev_samp(x) * sqrt(252)), 6) AS sharpe_ratio FROM (SELECT symbol, ret / 100 AS x FROM ret WHERE ret IS NOT NULL) GROUP BY symbol HAVING count(*) > 1", RET))
def b19(spark, sf):
    rows = features.with_returns(week(spark, sf)).where("ret is not null").withColumn("ret", F.col("ret") / 100)
    return metrics.summary(rows, "symbol").where("n_sessions > 1").select("symbol", "n_sessions", *[r(c).alias(c) for c in ("annualised_return", "annualised_volatility", "sharpe_ratio")])


@query("b20_purged_folds", "SELECT CAST(fold AS INT) AS fold, CAST(idx AS INT) AS idx, CASE WHEN idx BETWEEN a AND b THEN 'test' ELSE 'train' END AS role FROM (SELECT fold, fold * 20 + least(fold, 3) AS a, (fold + 1) * 20 + least(fold + 1, 3) - 1 AS b FROM range(5) t(fold)) JOIN range(103) u(idx) ON idx BETWEEN a AND b OR idx < a - 4 OR idx > b + 2")
def b20(spark, sf):
    return metrics.purged_folds(spark, 103, 5, horizon=4, embargo=2)


# Statistics and evaluation


@query("a05_kappa", "SELECT n, round(agreement, 6) AS agreement, round((agreement - chance) / (1 - chance), 6) AS kappa FROM (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS agreement, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS chance FROM labels)")
def a05(spark, sf):
    return evaluate.kappa(table(spark, sf, "labels"), "quality", "toxic").select("n", r("agreement").alias("agreement"), r("kappa").alias("kappa"))


@query("a06_abstention_curve", "SELECT c AS coverage, CAST(greatest(1, round_even(c * n, 0)) AS INT) AS kept, round((SELECT avg(o_totalprice) FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS k FROM orders) WHERE k <= greatest(1, round_even(c * n, 0))), 4) AS performance FROM (SELECT unnest([0.1, 0.25, 0.5, 1.0])::DOUBLE AS c) , (SELECT count(*) AS n FROM orders)")
def a06(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("score"), F.col("o_totalprice").alias("value"))
    return evaluate.abstention_curve(rows, [0.1, 0.25, 0.5, 1.0]).withColumn("performance", r("performance", 4))


@query("e20_exact_duplicates", sql("SELECT symbol AS name, min(symbol) OVER (PARTITION BY sig) AS cluster FROM (SELECT symbol, string_agg(session_date || ':' || n, ',' ORDER BY session_date) AS sig FROM ev GROUP BY symbol)"))
def e20(spark, sf):
    return evaluate.exact_duplicates(event_panel(spark, sf).select(F.col("symbol").alias("name"), "session_date", F.col("n").cast("double").alias("ret")))


# Stress


@query("r01_regime_features", sql("SELECT session_date, round(ln(vol), 6) AS log_vol, round(trend, 6) AS trend FROM (SELECT session_date, CASE WHEN count(x) OVER w = 21 THEN stddev_samp(x) OVER w * sqrt(252) END AS vol, CASE WHEN count(x) OVER w = 21 THEN sum(x) OVER w END AS trend FROM (SELECT session_date, ln(close / lag(close) OVER (ORDER BY session_date)) AS x FROM idx) WINDOW w AS (ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) WHERE vol > 0", "idx AS (SELECT session_date, avg(close) AS close FROM wk GROUP BY 1)"))
def r01(spark, sf):
    return stress.regime_features(index(spark, sf)).select("session_date", r("log_vol").alias("log_vol"), r("trend").alias("trend"))


def index(spark, sf):
    return week(spark, sf).groupBy("session_date").agg(F.avg("close").alias("close"))


@query("r05_regime_labels")
def r05(spark, sf):
    return stress.regime_labels(stress.regime_features(index(spark, sf)), ["1996-01-01", "1997-01-01"], at_least=60)


@query("r12_fragility", sql("SELECT symbol, count(*) AS regimes, round(var_samp(s) / abs(avg(s)), 4) AS fragility FROM (SELECT symbol, year(session_date) AS state, avg(ret) / stddev_samp(ret) * sqrt(252) AS s FROM ret WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 21 AND stddev_samp(ret) > 1e-12) GROUP BY symbol HAVING count(*) >= 2", RET))
def r12(spark, sf):
    rows = features.with_returns(week(spark, sf)).where("ret is not null").withColumn("state", F.year("session_date"))
    return stress.fragility(rows, ["symbol"]).where("regimes >= 2").select("symbol", "regimes", r("fragility", 4).alias("fragility"))
