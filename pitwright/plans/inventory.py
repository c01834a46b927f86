"""The small operators, each as a query of its own: joins, aggregates, windows, order, sets, functions, calendars."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.functions.checks import known_before
from pitwright.operators import adjust, backtest, calendar, capacity, costs, evaluate, features, frames, labels, metrics, stress, universe
from pitwright.plans.domain import CAPACITY, COSTS, FLOW, MEASURES, MOMENTUM, RET, UNIVERSE, legs, momentum_scores, per_session
from pitwright.plans.relational import ORACLES, QUERIES, query, r, sql, week
from pitwright.sources.panels import event_panel, net_flow, price_panel, session_path, stated_date, table

__all__ = ["ORACLES", "QUERIES"]

#: A number from 0 to below 1 of a text, as operators.frames.uniform makes it.
UNIFORM = "(('0x' || substr(sha256({}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"
OVER = "OVER (PARTITION BY symbol ORDER BY session_date)"


def day(spark, sf):
    return price_panel(spark, sf, "day").withColumn("adj_close", F.col("close"))


# Sources


@query("s03_session_paths", sql("SELECT DISTINCT session_date, '/raw/prices/session_date=' || CAST(session_date AS VARCHAR) AS path FROM wk"))
def s03(spark, sf):
    days = week(spark, sf).select("session_date").distinct()
    return days.select("session_date", session_path("/raw", F.col("session_date")).alias("path"))


STAMPS = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 1 THEN upper(strftime(o_orderdate, '%d-%b-%Y')) WHEN 2 THEN strftime(o_orderdate, '%d-%B-%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query("s05_stated_dates", f"SELECT o_orderkey, {STAMPS} AS stamp, CAST(o_orderdate AS DATE) AS stated FROM orders")
def s05(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    stamp = F.when(k == 0, F.date_format(d, "dd-MMM-yyyy")).when(k == 1, F.upper(F.date_format(d, "dd-MMM-yyyy"))).when(k == 2, F.date_format(d, "dd-MMMM-yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", stamp.alias("stamp")).withColumn("stated", stated_date(F.col("stamp")))


# Projections, filters, guards


@query("p01_select_rename", sql("SELECT symbol AS name, session_date AS day, close AS last_price FROM wk"))
def p01(spark, sf):
    return week(spark, sf).select(F.col("symbol").alias("name"), F.col("session_date").alias("day"), F.col("close").alias("last_price"))


@query("p03_drop_prefixed", "SELECT * EXCLUDE (p_name, p_brand, p_type, p_size, p_retailprice, ps_x) FROM (SELECT *, 1 AS ps_x, p_partkey AS k FROM part)")
def p03(spark, sf):
    rows = table(spark, sf, "part").withColumns({"ps_x": F.lit(1), "k": F.col("p_partkey")}).withColumnRenamed("p_partkey", "q_partkey")
    return frames.drop_prefixed(rows, "p").withColumnRenamed("q_partkey", "p_partkey")


@query("p04_filter", "SELECT p_partkey FROM part WHERE (p_size > 20 AND p_retailprice < 1500) OR NOT (p_brand = 'Brand#11' OR p_size >= 5)")
def p04(spark, sf):
    size, price, brand = F.col("p_size"), F.col("p_retailprice"), F.col("p_brand")
    return table(spark, sf, "part").where(((size > 20) & (price < 1500)) | ~((brand == "Brand#11") | (size >= 5))).select("p_partkey")


FLAGS = "fl AS (SELECT symbol, min(session_date) + 70 AS a, min(session_date) + 700 AS b, 'early' AS reason FROM wk GROUP BY 1 UNION ALL SELECT symbol, max(session_date) - 400, max(session_date), 'late' FROM wk WHERE symbol < 'Brand#3' GROUP BY 1)"


def flags(spark, sf):
    ends = week(spark, sf).groupBy("symbol").agg(F.min("session_date").alias("lo"), F.max("session_date").alias("hi"))
    early = ends.select("symbol", F.date_add("lo", 70).alias("start_date"), F.date_add("lo", 700).alias("end_date"), F.lit("early").alias("reason"))
    return early.unionByName(ends.where("symbol < 'Brand#3'").select("symbol", F.date_sub("hi", 400).alias("start_date"), F.col("hi").alias("end_date"), F.lit("late").alias("reason")))


@query("p10_interval_points", sql("SELECT w.symbol, w.session_date, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM wk w LEFT JOIN fl ON fl.symbol = w.symbol AND w.session_date BETWEEN a AND b GROUP BY 1, 2", FLAGS))
def p10(spark, sf):
    points = adjust.flagged_points(week(spark, sf).select("symbol", "session_date"), flags(spark, sf))
    return points.select("symbol", "session_date", F.array_join("reasons", ",").alias("reasons"))


@query("p11_known_before", sql("SELECT symbol, session_date FROM wk WHERE session_date < DATE '1996-01-01'"))
def p11(spark, sf):
    past = week(spark, sf).where("session_date < '1996-01-01'").select("symbol", "session_date")
    return known_before(past, "session_date", F.lit("1996-01-01").cast("date"))


@query("p12_signal_guards", sql("SELECT a.session_date AS information_at, b.session_date AS decision_session, c.session_date AS session_date FROM cal a JOIN cal b ON b.session_idx = a.session_idx + a.session_idx % 2 JOIN cal c ON c.session_idx = b.session_idx + 1"))
def p12(spark, sf):
    cal = calendar.build(week(spark, sf))
    at = lambda name: cal.select(F.col("session_date").alias(name), F.col("session_idx").alias(f"i_{name}"))
    both = at("information_at").join(at("decision_session"), F.col("i_decision_session") == F.col("i_information_at") + F.col("i_information_at") % 2)
    both = both.join(at("session_date"), F.col("i_session_date") == F.col("i_decision_session") + 1)
    return backtest.validate_signals(both.select("information_at", "decision_session", "session_date"))


@query("p13_numbers_of_members", sql("SELECT session_date, symbol, weight FROM (SELECT session_date, symbol, CASE WHEN k % 3 <> 0 THEN round(1.0 / k, 9) END AS weight FROM (SELECT session_date, symbol, row_number() OVER (PARTITION BY session_date ORDER BY symbol) + 3 AS k FROM wk)) WHERE weight IS NOT NULL AND symbol <> 'Brand#12'"))
def p13(spark, sf):
    panel = week(spark, sf)
    k = F.row_number().over(W.partitionBy("session_date").orderBy("symbol")) + 3
    rows = panel.select(F.lit("s").alias("strategy"), "session_date", "symbol", F.when(k % 3 != 0, r(1.0 / k, 9)).otherwise(F.lit(float("nan"))).alias("weight"))
    return backtest.clamp(rows, panel.where("symbol != 'Brand#12'"), max_gross=100.0).select("session_date", "symbol", "weight")


@query("p16_drop_flagged", sql("SELECT symbol, session_date FROM wk WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.symbol = wk.symbol AND session_date BETWEEN a AND b)", FLAGS))
def p16(spark, sf):
    return adjust.without_flagged(week(spark, sf), flags(spark, sf)).select("symbol", "session_date")


@query("p18_number_formats", "SELECT o_orderkey, printf('%.2f', o_totalprice) AS fixed, printf('%+.2f', o_totalprice) AS signed, format('{:,}', o_orderkey * 1001) AS grouped, printf('%.1f%%', (o_orderkey % 1000) / 1000.0::DOUBLE * 100) AS percent, regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g') AS letters FROM orders")
def p18(spark, sf):
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", frames.fixed(t).alias("fixed"), frames.signed(t).alias("signed"), frames.grouped(k * 1001).alias("grouped"), frames.percent((k % 1000) / F.lit(1000.0)).alias("percent"), F.regexp_replace("o_orderpriority", "[^A-Za-z]", "").alias("letters"))


# Joins


@query("j03_inner_other_names", "SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j03(spark, sf):
    c, n = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment").distinct()


@query("j07_rates_in_force", sql("SELECT o_orderkey, CAST(x AS DOUBLE) AS exchange FROM rated", COSTS))
def j07(spark, sf):
    return legs(spark, sf).select("o_orderkey", costs.epoch_of(F.col("on")).getField("exchange").alias("exchange"))


@query("j10_point_lookups", sql("SELECT k.symbol, k.session_date, open, close, turnover_inr FROM (SELECT symbol, session_date FROM dy WHERE isodow(session_date) = 1) k LEFT JOIN wk USING (symbol, session_date)"))
def j10(spark, sf):
    keys = day(spark, sf).where(F.weekday("session_date") == 0).select("symbol", "session_date")
    return keys.join(week(spark, sf).select("symbol", "session_date", "open", "close", "turnover_inr"), ["symbol", "session_date"], "left")


@query("j12_gather", sql("SELECT p AS path_id, t AS step, CAST((t * 7 + p * 13) % n AS INT) AS src_idx, session_date FROM range(20) a(p), range(100) b(t), (SELECT count(*) AS n FROM cal), cal WHERE session_idx = (t * 7 + p * 13) % n"))
def j12(spark, sf):
    cal = calendar.build(week(spark, sf))
    n = cal.count()
    paths = spark.range(20).select(F.col("id").alias("path_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint"))).alias("step"))
    return stress.gather(paths.withColumn("src_idx", ((F.col("step") * 7 + F.col("path_id") * 13) % n).cast("int")), cal).select("path_id", "step", "src_idx", "session_date")


@query("j14_common_keys", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0)")
def j14(spark, sf):
    c, s = (table(spark, sf, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return frames.common_keys(c, s, table(spark, sf, "nation").where("n_regionkey > 0").select(F.col("n_nationkey").alias("k")))


# Aggregates


@query("e02_group_mean", sql("SELECT session_date, round(avg(close), 6) AS close FROM wk GROUP BY 1"))
def e02(spark, sf):
    return week(spark, sf).groupBy("session_date").agg(r(F.avg("close")).alias("close"))


@query("e03_sum_of_product", "SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY 1")
def e03(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


NAMED = "nm AS (SELECT session_date, symbol, turnover_inr AS v, row_number() OVER (PARTITION BY session_date ORDER BY turnover_inr, symbol) AS k FROM wk)"


@query("e05_least_and_second", sql("SELECT session_date, round(min(v), 6) AS least, max(symbol) FILTER (WHERE k = 1) AS name, round(max(v) FILTER (WHERE k = 2), 6) AS second, count(*) AS n FROM nm GROUP BY 1", NAMED))
def e05(spark, sf):
    panel = week(spark, sf)
    traded = panel.select("session_date", F.lit("all").alias("factor"), "symbol", F.lit(1.0).alias("traded_fraction"))
    out = capacity.session_capacity(traded, panel.withColumn("adv_inr", F.col("turnover_inr")), participation=1.0)
    return out.select("session_date", r("capacity_inr").alias("least"), F.col("binding_symbol").alias("name"), r("second_capacity").alias("second"), F.col("n_names").alias("n"))


STATES = f"{CAPACITY}, {FLOW}, fs AS (SELECT session_date, CASE WHEN z >= 1 THEN 'inflow' WHEN z <= -1 THEN 'outflow' ELSE 'neutral' END AS flow_state FROM zed WHERE z IS NOT NULL)"
YEARS = f"{CAPACITY}, st AS (SELECT *, CAST(year(session_date) AS VARCHAR) AS flow_state FROM percap)"


@query("e06_q10_capacity_by_state", sql("SELECT flow_state, round(median(capacity), 6) AS median_capacity, round(max(capacity) FILTER (WHERE i = CAST(floor((many - 1) * 0.05::DOUBLE + 0.5) AS BIGINT)), 6) AS p05_capacity, count(*) AS n_sessions FROM (SELECT *, row_number() OVER (PARTITION BY flow_state ORDER BY capacity, session_date) - 1 AS i, count(*) OVER (PARTITION BY flow_state) AS many FROM st) GROUP BY 1", YEARS))
def e06(spark, sf):
    per = per_session(spark, sf)
    states = per.select("session_date", F.year("session_date").cast("string").alias("flow_state")).distinct()
    out = capacity.capacity_by_state(per, states)
    return out.select("flow_state", r("median_capacity").alias("median_capacity"), r("p05_capacity").alias("p05_capacity"), "n_sessions")


@query("e07_frequencies", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def e07(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("e11_first_of_each", "SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY 1")
def e11(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").alias("ts"))


@query("e12_log_log_slopes", sql("SELECT symbol, round(regr_slope(ln(volume), ln(turnover_inr)), 6) AS slope, round(regr_intercept(ln(volume), ln(turnover_inr)), 6) AS intercept, round(regr_r2(ln(volume), ln(turnover_inr)), 6) AS r_squared, count(*) AS n FROM wk GROUP BY 1"))
def e12(spark, sf):
    y, x = F.ln("volume"), F.ln("turnover_inr")
    return week(spark, sf).groupBy("symbol").agg(r(F.regr_slope(y, x)).alias("slope"), r(F.regr_intercept(y, x)).alias("intercept"), r(F.regr_r2(y, x)).alias("r_squared"), F.count("*").alias("n"))


FITS = f"{MEASURES}, fits AS (SELECT symbol, regr_slope(ret, x) AS slope, sqrt((regr_syy(ret, x) - regr_sxy(ret, x) ** 2 / regr_sxx(ret, x)) / (count(*) - 2) / regr_sxx(ret, x)) AS se FROM (SELECT symbol, ret, turnover_inr / adv_inr AS x FROM meas) WHERE ret IS NOT NULL AND x IS NOT NULL GROUP BY symbol HAVING count(*) > 2)"


def fits(spark, sf):
    return capacity.slopes(features.daily_measures(week(spark, sf), window=8), ["symbol"], "ret", "rel_value")


@query("e14_pooled_slopes", sql("SELECT round(sum(slope / se ** 2) / sum(1 / se ** 2), 6) AS pooled, round(1 / sqrt(sum(1 / se ** 2)), 6) AS pooled_error, round(avg(slope), 6) AS equal_weight, round(stddev_samp(slope) / sqrt(count(*)), 6) AS equal_weight_error, round(median(se), 6) AS median_error, round(2.8015852181129682 / sqrt(sum(1 / se ** 2)), 6) AS detectable, count(*) AS n FROM fits WHERE se > 0", FITS))
def e14(spark, sf):
    out = capacity.pooled(fits(spark, sf))
    return out.select(*[r(c).alias(c) for c in out.columns if c != "n"], "n")


@query("e15_shares_and_quantiles", sql("SELECT round(avg((se < 1)::INT), 6) AS share, round(log10(max(se) / min(se)), 6) AS decades, round(quantile_cont(se, 0.25), 6) AS lower, round(quantile_cont(se, 0.75), 6) AS upper FROM fits", FITS))
def e15(spark, sf):
    out = capacity.spread(fits(spark, sf), "standard_error", below=1.0)
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("e16_amihud", sql("SELECT symbol, round(avg(amihud) * 1e6, 6) AS amihud FROM meas GROUP BY 1", MEASURES))
def e16(spark, sf):
    return capacity.amihud(features.daily_measures(week(spark, sf), window=8)).select("symbol", r(F.col("amihud") * 1e6).alias("amihud"))


@query("e18_group_summary", sql("SELECT symbol, round(min(volume), 6) AS least, round(min_by(volume, session_date), 6) AS first, round(median(volume), 6) AS middle, round(quantile_cont(volume, 0.05), 6) AS p05, round(quantile_cont(volume, 0.95), 6) AS p95, count(*) AS n FROM wk GROUP BY 1"))
def e18(spark, sf):
    v = "volume"
    return week(spark, sf).groupBy("symbol").agg(r(F.min(v)).alias("least"), r(F.min_by(v, "session_date")).alias("first"), r(F.median(v)).alias("middle"), r(F.percentile(v, 0.05)).alias("p05"), r(F.percentile(v, 0.95)).alias("p95"), F.count("*").alias("n"))


@query("e22_funnel", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE a) AS large, round(avg(a::INT), 6) AS large_rate, count(*) FILTER (WHERE a AND b) AS urgent, round(avg((a AND b)::INT), 6) AS urgent_rate FROM (SELECT o_orderstatus, o_totalprice > 50000 AS a, o_orderpriority < '3' AS b FROM orders) GROUP BY 1")
def e22(spark, sf):
    out = frames.funnel(table(spark, sf, "orders"), ["o_orderstatus"], {"large": F.col("o_totalprice") > 50000, "urgent": F.col("o_orderpriority") < "3"})
    return out.withColumns({c: r(c) for c in ("large_rate", "urgent_rate")})


@query("e24_vwap", sql("SELECT session_date, round(sum(close * volume) / sum(volume), 6) AS vwap FROM wk GROUP BY 1"))
def e24(spark, sf):
    return week(spark, sf).groupBy("session_date").agg(r(F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("vwap"))


# Windows


@query("w02_lags", sql(f"SELECT symbol, session_date, lag(close, 21) {OVER} AS month, lag(close, 252) {OVER} AS year FROM dy"))
def w02(spark, sf):
    return day(spark, sf).select("symbol", "session_date", features.lagged("close", 21).alias("month"), features.lagged("close", 252).alias("year"))


@query("w03_leads", sql(f"SELECT symbol, session_date, round(lead(close, 6) {OVER} / lead(close, 1) {OVER} - 1, 6) AS fwd_5 FROM dy"))
def w03(spark, sf):
    return labels.forward_returns(day(spark, sf), (5,)).select("symbol", "session_date", r("fwd_5").alias("fwd_5"))


def behind(how: str, n: int, least: int | None = None) -> str:
    w = f"(PARTITION BY symbol ORDER BY session_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    c = how[how.index("(") + 1 : -1]
    return f"CASE WHEN count({c}) OVER {w} >= {least or n} THEN {how} OVER {w} END"


DRET = "dret AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS ret FROM dy)"


@query("w05_trailing_deviation", sql(f"SELECT symbol, session_date, round({behind('stddev_samp(ret)', 126)}, 5) AS sd FROM dret", DRET))
def w05(spark, sf):
    return features.with_returns(day(spark, sf)).select("symbol", "session_date", r(features.trailing("ret", 126, F.stddev_samp), 5).alias("sd"))


@query("w07_log_of_mean", sql(f"SELECT symbol, session_date, round(-ln(1 + {behind('avg(turnover_inr)', 126)}), 6) AS size FROM dy"))
def w07(spark, sf):
    return day(spark, sf).select("symbol", "session_date", r(-F.log1p(features.trailing("turnover_inr", 126))).alias("size"))


@query("w08_z_scores", sql("SELECT session_date, round(rolling, 6) AS rolling, round(z, 6) AS z FROM roll JOIN zed USING (session_date)", FLOW))
def w08(spark, sf):
    return capacity.flow_states(net_flow(spark, sf), window=3, baseline=10).select("session_date", r("rolling").alias("rolling"), r("z").alias("z"))


INDEX = "ix AS (SELECT session_date, avg(close) AS close FROM dy GROUP BY 1)"


@query("w09_volatility_and_trend", sql("SELECT session_date, round(ln(vol), 6) AS log_vol, round(trend, 6) AS trend FROM (SELECT session_date, CASE WHEN count(x) OVER w = 21 THEN stddev_samp(x) OVER w * sqrt(252) END AS vol, CASE WHEN count(x) OVER w = 21 THEN sum(x) OVER w END AS trend FROM (SELECT session_date, ln(close / lag(close) OVER (ORDER BY session_date)) AS x FROM ix) WINDOW w AS (ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) WHERE vol > 0", INDEX))
def w09(spark, sf):
    index = day(spark, sf).groupBy("session_date").agg(F.avg("close").alias("close"))
    return stress.regime_features(index).select("session_date", r("log_vol").alias("log_vol"), r("trend").alias("trend"))


@query("w10_w11_ranks_and_sides", sql("SELECT session_date, symbol, CAST(side AS INT) AS side, round(side / count(*) OVER (PARTITION BY session_date, side), 9) AS weight, k, n FROM sided WHERE side IS NOT NULL", MOMENTUM))
def w10(spark, sf):
    scores = momentum_scores(week(spark, sf))
    group = W.partitionBy("session_date")
    ranked = scores.select("session_date", "symbol", F.row_number().over(group.orderBy("score", "symbol")).cast("bigint").alias("k"), F.count("*").over(group).alias("n"))
    book = features.long_short(scores, quantile=0.2)
    return book.join(ranked, ["session_date", "symbol"]).select("session_date", "symbol", F.signum("weight").cast("int").alias("side"), r("weight", 9).alias("weight"), "k", "n")


@query("w12_descending_rank", sql("SELECT session_date, symbol, row_number() OVER (PARTITION BY session_date ORDER BY turnover_inr DESC, symbol) AS place FROM wk"))
def w12(spark, sf):
    return week(spark, sf).select("session_date", "symbol", F.row_number().over(W.partitionBy("session_date").orderBy(F.desc("turnover_inr"), "symbol")).cast("bigint").alias("place"))


@query("w14_later_factors", sql("SELECT symbol, session_date, coalesce((SELECT product(f) FROM ex WHERE ex.symbol = wk.symbol AND ex.session_date > wk.session_date), 1.0) AS divisor FROM wk", "ex AS (SELECT symbol, min(session_date) AS session_date, 2.0::DOUBLE AS f FROM wk WHERE session_date > DATE '1994-06-01' GROUP BY 1 UNION ALL SELECT symbol, min(session_date), 1.5::DOUBLE FROM wk WHERE session_date > DATE '1996-06-01' GROUP BY 1)"))
def w14(spark, sf):
    panel = week(spark, sf)
    events = [panel.where(f"session_date > '{d}'").groupBy("symbol").agg(F.min("session_date").alias("ex_date")).withColumn("factor", F.lit(f)) for d, f in (("1994-06-01", 2.0), ("1996-06-01", 1.5))]
    return adjust.back_adjust(panel, events[0].unionByName(events[1])).select("symbol", "session_date", "divisor")


@query("w18_w19_anchors_and_log_returns", sql(f"SELECT symbol, session_date, first_value(close) {OVER} AS anchor, round(ln(close / lag(close) {OVER}), 6) AS log_return, lag(session_date) {OVER} AS since FROM dy"))
def w18(spark, sf):
    return day(spark, sf).select("symbol", "session_date", F.first("close").over(features.by_symbol()).alias("anchor"), r(F.ln(F.col("close") / features.lagged("close"))).alias("log_return"), features.lagged("session_date").alias("since"))


@query("w22_book_changes", sql("SELECT session_date, symbol, round(coalesce(a.weight, 0) - coalesce(b.weight, 0), 9) AS change FROM book a FULL JOIN prev b USING (session_date, symbol)", CAPACITY))
def w22(spark, sf):
    from pitwright.plans.domain import book

    weights = book(week(spark, sf)).withColumn("strategy", F.lit("m"))
    moved = backtest.changes(weights, weights.select("strategy", "session_date").distinct())
    return moved.select("session_date", "symbol", r(F.col("weight") - F.col("previous"), 9).alias("change"))


# Order, sets, shape, samples


@query("t01_mixed_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey DESC) AS place FROM orders")
def t01(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return frames.global_rank(rows, F.desc("o_orderpriority"), F.asc("o_totalprice"), F.desc("o_orderkey")).select("o_orderkey", F.col("rank").alias("place"))


@query("t03_tail", sql("SELECT symbol, session_date FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS k FROM dy) WHERE k <= 5"))
def t03(spark, sf):
    return frames.tail(day(spark, sf), "symbol", "session_date", 5).select("symbol", "session_date")


@query("t05_coverage_heads", "SELECT c AS coverage, CAST(greatest(1, round_even(c * n, 0)) AS INT) AS kept, round(avg(c_acctbal), 6) AS performance FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k, count(*) OVER () AS n FROM customer), (SELECT unnest([0.0, 0.05, 0.33, 1.0])::DOUBLE AS c) WHERE k <= greatest(1, round_even(c * n, 0)) GROUP BY 1, 2")
def t05(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.col("c_acctbal").alias("score"), F.col("c_acctbal").alias("value"))
    return evaluate.abstention_curve(rows, [0.0, 0.05, 0.33, 1.0]).withColumn("performance", r("performance"))


@query("t06_session_slice", sql("SELECT symbol, session_date FROM wk JOIN cal USING (session_date) WHERE session_idx BETWEEN 50 AND 69"))
def t06(spark, sf):
    panel = week(spark, sf)
    return frames.between_sessions(panel, calendar.build(panel), 50, 20).select("symbol", "session_date")


@query("u02_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def u02(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("u07_remap", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS o_orderstatus FROM orders")
def u07(spark, sf):
    return frames.remap(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "filled", "O": "open"}, "other")


@query("u08_row_numbers", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
def u08(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("n"))


def drawn(n: str, paths: int, block: float, seed: int, to: str | None = None, tables: str = "") -> str:
    """Paths as operators.stress.bootstrap_paths draws them; `to`: where a jump goes, of the uniform number u2."""
    u = UNIFORM.format
    return f"""steps AS (SELECT p AS path_id, t AS step, t = 0 OR {u(f"'{seed}|' || p || '|' || t || '|jump'")} < 1.0 / {block} AS jump, {u(f"'{seed}|' || p || '|' || t || '|to'")} AS u2, n FROM range({paths}) a(p), (SELECT n, unnest(range(n)) AS t FROM (SELECT {n} AS n)))"""


def paths_sql(to: str = "CAST(floor(u2 * n) AS BIGINT)", source: str = "steps") -> str:
    return f"paths AS (SELECT path_id, step, (last.tt + step - last.s) % n AS src_idx FROM (SELECT *, last_value(CASE WHEN jump THEN {{'s': step, 'tt': {to}}} END IGNORE NULLS) OVER (PARTITION BY path_id ORDER BY step) AS last FROM {source}))"


@query("u09_bootstrap_paths", f"WITH {drawn('150', 40, 8.0, 42)}, {paths_sql()} SELECT path_id, CAST(step AS INT) AS step, CAST(src_idx AS INT) AS src_idx FROM paths")
def u09(spark, sf):
    return stress.bootstrap_paths(spark, 150, 40, 8.0, 42)


@query(
    "u10_paths_by_label",
    sql(
        "SELECT path_id, CAST(step AS INT) AS step, CAST(src_idx AS INT) AS src_idx FROM paths",
        f"{drawn('(SELECT count(*) FROM cal)', 10, 5.0, 7)}, lb AS (SELECT session_idx, year(session_date) % 3 AS label, row_number() OVER (PARTITION BY year(session_date) % 3 ORDER BY session_idx) - 1 AS place, count(*) OVER (PARTITION BY year(session_date) % 3) AS size FROM cal), jumps AS (SELECT s.*, q.session_idx AS target FROM steps s JOIN lb a ON a.session_idx = s.step JOIN lb q ON q.label = a.label AND q.place = CAST(floor(u2 * a.size) AS BIGINT)), {paths_sql('target', 'jumps')}",
    ),
)
def u10(spark, sf):
    cal = calendar.build(week(spark, sf))
    return stress.bootstrap_paths(spark, cal.count(), 10, 5.0, 7, cal.select("session_idx", (F.year("session_date") % 3).alias("label")))


@query("u11_contiguous_folds", "SELECT CAST(fold AS INT) AS fold, CAST(idx AS INT) AS idx FROM (SELECT fold, fold * 14 + least(fold, 3) AS a, (fold + 1) * 14 + least(fold + 1, 3) - 1 AS b FROM range(7) t(fold)) JOIN range(101) u(idx) ON idx BETWEEN a AND b")
def u11(spark, sf):
    return metrics.purged_folds(spark, 101, 7, horizon=0, embargo=0).where("role = 'test'").select("fold", "idx")


@query("u12_random_folds_and_samples", f"SELECT c_custkey, CAST(floor({UNIFORM.format(chr(39) + '5|' + chr(39) + ' || c_custkey')} * 5) AS INT) AS fold FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY {UNIFORM.format(chr(39) + '9|' + chr(39) + ' || c_custkey')}, c_custkey) <= 10")
def u12(spark, sf):
    rows = frames.subsample(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", 10, 9)
    return frames.random_folds(rows, "c_custkey", 5, 5).select("c_custkey", "fold")


@query("u13_block_resample", f"SELECT d AS draw, CAST(b * 6 + i AS INT) AS step, CAST(floor({UNIFORM.format(chr(39) + '3|' + chr(39) + ' || d || ' + chr(39) + '|' + chr(39) + ' || b')} * 115) + i AS INT) AS src_idx FROM range(30) x(d), range(5) y(b), range(6) z(i)")
def u13(spark, sf):
    return frames.block_resample(spark, 120, 5, 6, 30, 3).withColumn("step", F.col("step").cast("int"))


# Scalar functions


@query("f01_arithmetic", "SELECT l_orderkey, l_linenumber, round(-l_quantity + l_extendedprice * 2 - l_tax / 3, 6) AS a, round(abs(l_quantity - 25), 6) AS b, l_linenumber % 3 AS c FROM lineitem")
def f01(spark, sf):
    q, p, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(-q + p * 2 - t / 3).alias("a"), r(F.abs(q - 25)).alias("b"), (F.col("l_linenumber") % 3).alias("c"))


@query("f03_bounds", "SELECT l_orderkey, l_linenumber, CAST(ceil(l_quantity / 7) AS BIGINT) AS up, greatest(5.0::DOUBLE, least(30.0::DOUBLE, l_quantity)) AS clipped, (l_linenumber + 2) // 3 AS thirds FROM lineitem")
def f03(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.ceil(q / 7).alias("up"), F.greatest(F.lit(5.0), F.least(F.lit(30.0), q)).alias("clipped"), F.expr("cast((l_linenumber + 2) div 3 as int)").alias("thirds"))


@query("f06_lengths_and_patterns", "SELECT p_partkey, length(p_type) AS n, regexp_extract(p_brand, 'Brand#(\\d)(\\d)', 2) AS second, regexp_matches(p_type, '^(PROMO|STANDARD) .*BRUSHED') AS hit FROM part")
def f06(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.length("p_type").cast("bigint").alias("n"), F.regexp_extract("p_brand", r"Brand#(\d)(\d)", 2).alias("second"), F.col("p_type").rlike("^(PROMO|STANDARD) .*BRUSHED").alias("hit"))


@query("f07_dates_of_texts", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate END AS DATE) AS parsed FROM orders")
def f07(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyyMMdd")).otherwise(F.lit("no date"))
    parsed = F.coalesce(*[F.to_date(F.try_to_timestamp("text", F.lit(f))) for f in ("dd/MM/yyyy", "yyyyMMdd")])
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", parsed.alias("parsed"))


@query("f09_weekdays_without_holidays", "SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(range(DATE '1995-01-01', DATE '1996-01-01', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 250000 AND year(o_orderdate) = 1995)")
def f09(spark, sf):
    holidays = table(spark, sf, "orders").where("o_totalprice > 250000 and year(o_orderdate) = 1995").select(F.to_date("o_orderdate").alias("holiday")).distinct()
    return calendar.weekdays("1995-01-01", "1995-12-31", holidays)


@query("f10_casts", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS whole, CAST(l_linenumber AS DOUBLE) AS real, CAST(l_orderkey AS VARCHAR) AS text, NULL::DOUBLE AS none, CAST(l_shipdate AS DATE) AS day FROM lineitem")
def f10(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", c("l_quantity").cast("bigint").alias("whole"), c("l_linenumber").cast("double").alias("real"), c("l_orderkey").cast("string").alias("text"), F.lit(None).cast("double").alias("none"), c("l_shipdate").cast("date").alias("day"))


@query("f11_maps_of_weights", sql("SELECT session_date, count(*) AS names, round(sum(a + b), 6) AS total, round(sum(a + b) FILTER (WHERE a + b > 0.5), 6) AS heavy FROM (SELECT session_date, coalesce(x.w, 0) AS a, coalesce(y.w, 0) AS b FROM (SELECT session_date, symbol, close / open / 2 AS w FROM wk WHERE symbol < 'Brand#4') x FULL JOIN (SELECT session_date, symbol, open / close / 2 AS w FROM wk WHERE symbol > 'Brand#2') y USING (session_date, symbol)) GROUP BY 1"))
def f11(spark, sf):
    panel = week(spark, sf)
    a, b = panel.where("symbol < 'Brand#4'"), panel.where("symbol > 'Brand#2'")
    side = lambda df, w, n: df.groupBy("session_date").agg(F.map_from_entries(F.collect_list(F.struct("symbol", w))).alias(n))
    both = side(a, F.col("close") / F.col("open") / 2, "a").join(side(b, F.col("open") / F.col("close") / 2, "b"), "session_date", "full")
    empty = F.create_map().cast("map<string,double>")
    both = both.select("session_date", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    zero = F.lit(0.0)
    summed = F.map_zip_with("a", "b", lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))
    total = lambda m: F.aggregate(F.map_values(m), zero, lambda s, x: s + x)
    heavy = F.map_filter(summed, lambda k, v: v > 0.5)
    return both.select("session_date", F.size(summed).cast("bigint").alias("names"), r(total(summed)).alias("total"), F.when(F.size(heavy) > 0, r(total(heavy))).alias("heavy"))


@query("f12_lists_of_windows", sql("SELECT symbol, session_date, l[-1] AS last, list_max(l) AS high, list_min(l) AS low, round(list_avg(l[-3:]), 6) AS mean3, len(list_filter(l, lambda x: x > 1000)) AS above FROM (SELECT symbol, session_date, list(close) OVER (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM wk) WHERE len(l) = 10"))
def f12(spark, sf):
    listed = week(spark, sf).select("symbol", "session_date", F.collect_list("close").over(features.by_symbol().rowsBetween(-9, 0)).alias("l")).where(F.size("l") == 10)
    mean3 = F.aggregate(F.slice("l", -3, 3), F.lit(0.0), lambda s, x: s + x) / 3
    return listed.select("symbol", "session_date", F.element_at("l", -1).alias("last"), F.array_max("l").alias("high"), F.array_min("l").alias("low"), r(mean3).alias("mean3"), F.size(F.filter("l", lambda x: x > 1000)).cast("bigint").alias("above"))


@query("f13_objects_in_texts", "SELECT event_id, json_extract_string(props, '$.k') AS k, greatest(0.0, least(1.0, value)) AS confidence FROM events WHERE value IS NOT NULL")
def f13(spark, sf):
    from pitwright.operators.audit import clamped, object_in

    rows = table(spark, sf, "events").where("value is not null").withColumn("text", F.concat(F.lit("noise "), "props", F.lit(" tail")))
    return rows.select("event_id", F.get_json_object(object_in(F.col("text")), "$.k").alias("k"), clamped(F.col("value").cast("string")).alias("confidence"))


@query("f15_cosines_and_least_squares", sql("SELECT a.symbol AS a, b.symbol AS b, round(sum(a.close * b.close) / sqrt(sum(a.close ** 2) * sum(b.close ** 2)), 6) AS cosine, round(regr_slope(a.close, b.close), 6) AS slope FROM wk a JOIN wk b ON a.session_date = b.session_date AND a.symbol < b.symbol GROUP BY 1, 2"))
def f15(spark, sf):
    a, b = (week(spark, sf).select("session_date", F.col("symbol").alias(n), F.col("close").alias(f"c{n}")) for n in "ab")
    x, y = F.col("ca"), F.col("cb")
    return a.join(b, "session_date").where("a < b").groupBy("a", "b").agg(r(F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"), r(F.regr_slope("ca", "cb")).alias("slope"))


@query("f16_trapezoids", "SELECT round(sum((x - px) * (y + py) / 2), 6) AS area FROM (SELECT x, y, lag(x) OVER (ORDER BY x) AS px, lag(y) OVER (ORDER BY x) AS py FROM (SELECT CAST(p_size AS DOUBLE) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1))")
def f16(spark, sf):
    curve = table(spark, sf, "part").groupBy(F.col("p_size").cast("double").alias("coverage")).agg(F.avg("p_retailprice").alias("performance"))
    return evaluate.area(curve).select(r("area").alias("area"))


# Calendar and universe


@query("c02_is_session", sql("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) IN (SELECT session_date FROM dcal) AS trades FROM orders"))
def c02(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return calendar.is_session(days, calendar.build(day(spark, sf)))


@query("c06_monthly_dates", sql("SELECT min(session_date) AS rebalance_date FROM dcal GROUP BY date_trunc('month', session_date)"))
def c06(spark, sf):
    return calendar.rebalance_dates(calendar.build(day(spark, sf)), "month")


def liquid(spark, sf):
    panel = week(spark, sf)
    cal = calendar.build(panel)
    return universe.liquidity(panel, cal, calendar.rebalance_dates(cal), trailing=12)


@query("d01_liquidity", sql("SELECT rebalance_date, symbol, round(m, 4) AS median_turnover, traded, w AS window FROM liq JOIN (SELECT rebalance_date, count(*) AS w FROM win GROUP BY 1) USING (rebalance_date)", UNIVERSE).replace("AS window", 'AS "window"'))
def d01(spark, sf):
    return liquid(spark, sf).select("rebalance_date", "symbol", r("median_turnover", 4).alias("median_turnover"), F.col("sessions_traded").alias("traded"), "window")


@query("d02_eligibility", sql("SELECT rebalance_date, count(*) AS eligible, min(traded) AS least_traded FROM elig GROUP BY 1", UNIVERSE))
def d02(spark, sf):
    ok = universe.ranked(liquid(spark, sf), min_listed=4, fraction=0.5)
    return ok.groupBy("rebalance_date").agg(F.count("*").alias("eligible"), F.min("sessions_traded").alias("least_traded"))
