"""Relational operators, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.operators import calendar, features
from pitwright.sources.panels import event_panel, net_flow, price_panel, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Panels of the queries, in SQL: weekly and daily prices by brand, days of events by type, days of net flow.
PANELS = """
px AS (SELECT p_brand AS symbol, l_shipdate, l_orderkey * 10 + l_linenumber AS k, l_extendedprice / l_quantity AS p, l_quantity AS q, l_extendedprice AS v
       FROM lineitem JOIN part ON l_partkey = p_partkey),
wk AS (SELECT symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS session_date, min_by(p, (k, p)) AS open, max(p) AS high, min(p) AS low, max_by(p, (k, p)) AS close, sum(q) AS volume, sum(v) AS turnover_inr
       FROM px GROUP BY 1, 2),
dy AS (SELECT symbol, CAST(l_shipdate AS DATE) AS session_date, min_by(p, (k, p)) AS open, max(p) AS high, min(p) AS low, max_by(p, (k, p)) AS close, sum(q) AS volume, sum(v) AS turnover_inr
       FROM px GROUP BY 1, 2),
ev AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS session_date, sum(value) AS value, count(*) AS n FROM events GROUP BY 1, 2),
net AS (SELECT CAST(ts AS DATE) AS session_date, sum(CASE WHEN event_type = 'purchase' THEN coalesce(value, 0) WHEN event_type = 'error' THEN -coalesce(value, 0) ELSE 0 END) AS net FROM events GROUP BY 1),
cal AS (SELECT session_date, CAST(row_number() OVER (ORDER BY session_date) - 1 AS INT) AS session_idx FROM (SELECT DISTINCT session_date FROM wk)),
dcal AS (SELECT session_date, CAST(row_number() OVER (ORDER BY session_date) - 1 AS INT) AS session_idx FROM (SELECT DISTINCT session_date FROM dy))
"""


def sql(body: str, ctes: str = "") -> str:
    return f"WITH {PANELS}{', ' + ctes if ctes else ''} {body}"


def query(name: str, oracle: str | None = None):
    """Registers a query under its operator's id, with its oracle."""

    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def week(spark: SparkSession, sf: str) -> DataFrame:
    return price_panel(spark, sf).withColumn("adj_close", F.col("close"))


# Projections and filters


@query("p02_computed_columns", sql("SELECT symbol, session_date, round(close - open, 8) AS change, round(abs((close - open) / open), 6) AS abs_move FROM wk"))
def p02(spark, sf):
    return week(spark, sf).withColumn("change", F.col("close") - F.col("open")).withColumn("abs_move", F.abs(F.col("change") / F.col("open"))).select("symbol", "session_date", r("change", 8).alias("change"), r("abs_move").alias("abs_move"))


@query("p05_date_window", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-07-01' AND l_quantity > 45")
def p05(spark, sf):
    return table(spark, sf, "lineitem").where("l_shipdate >= '1995-01-01' and l_shipdate < '1995-07-01' and l_quantity > 45").select("l_orderkey", "l_linenumber")


@query("p06_is_in", sql("SELECT symbol, session_date, round(close, 8) AS close FROM wk WHERE symbol IN (SELECT symbol FROM wk GROUP BY symbol ORDER BY sum(turnover_inr) DESC, symbol LIMIT 5)"))
def p06(spark, sf):
    panel = week(spark, sf)
    largest = panel.groupBy("symbol").agg(F.sum("turnover_inr").alias("t")).orderBy(F.desc("t"), "symbol").limit(5)
    return panel.join(largest, "symbol", "left_semi").select("symbol", "session_date", r("close", 8).alias("close"))


@query("p07_three_way_case", sql("SELECT symbol, session_date, CASE WHEN close > open * 1.5 THEN 'up' WHEN close < open / 1.5 THEN 'down' ELSE 'flat' END AS move FROM wk"))
def p07(spark, sf):
    c, o = F.col("close"), F.col("open")
    return week(spark, sf).select("symbol", "session_date", F.when(c > o * 1.5, "up").when(c < o / 1.5, "down").otherwise("flat").alias("move"))


@query("p08_drop_nulls", "SELECT event_id, value FROM events WHERE value IS NOT NULL")
def p08(spark, sf):
    return table(spark, sf, "events").where("value is not null").select("event_id", "value")


@query("p09_fill_null", "SELECT event_id, coalesce(value, 0.0) AS value FROM events")
def p09(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce("value", F.lit(0.0)).alias("value"))


@query("p14_circuit_band", sql("SELECT symbol, session_date, coalesce(prior > 0 AND abs(open / prior - 1) <= 0.2 + 1e-12, false) AS inside FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY session_date) AS prior FROM wk)"))
def p14(spark, sf):
    from pitwright.operators.costs import within_circuit

    panel = week(spark, sf).withColumn("prior", features.lagged("close"))
    return panel.select("symbol", "session_date", within_circuit(F.col("open"), F.col("prior"), 0.2).alias("inside"))


@query("p15_validation", "SELECT count(*) AS n, count(*) FILTER (WHERE trim(p_name) = '') AS blank, count(*) FILTER (WHERE p_size NOT BETWEEN 1 AND 50) AS out_of_domain, count(*) - count(DISTINCT p_partkey) AS repeated FROM part")
def p15(spark, sf):
    return table(spark, sf, "part").agg(F.count("*").alias("n"), F.count_if(F.trim("p_name") == "").alias("blank"), F.count_if(~F.col("p_size").between(1, 50)).alias("out_of_domain"), (F.count("*") - F.count_distinct("p_partkey")).alias("repeated"))


@query("p17_eligible_then_scored", sql("SELECT symbol, round(avg(close), 6) AS mean_close FROM wk WHERE session_date >= DATE '1996-01-01' AND symbol IN (SELECT symbol FROM wk WHERE session_date < DATE '1996-01-01' GROUP BY symbol HAVING median(turnover_inr) > (SELECT median(turnover_inr) FROM wk WHERE session_date < DATE '1996-01-01')) GROUP BY symbol"))
def p17(spark, sf):
    panel = week(spark, sf)
    early = panel.where("session_date < '1996-01-01'")
    level = early.agg(F.median("turnover_inr").alias("level"))
    eligible = early.groupBy("symbol").agg(F.median("turnover_inr").alias("m")).join(F.broadcast(level)).where("m > level")
    return panel.where("session_date >= '1996-01-01'").join(eligible, "symbol", "left_semi").groupBy("symbol").agg(r(F.avg("close")).alias("mean_close"))


# Joins


@query("j01_inner_one_key", sql("SELECT ev.symbol, session_date, round(value, 4) AS value, round(net, 4) AS net FROM ev JOIN net USING (session_date)"))
def j01(spark, sf):
    return event_panel(spark, sf).join(net_flow(spark, sf), "session_date").select("symbol", "session_date", r("value", 4).alias("value"), r("net", 4).alias("net"))


@query("j02_inner_two_keys", sql("SELECT w.symbol, w.session_date, round(w.close, 8) AS week_close, round(d.close, 8) AS day_close FROM wk w JOIN dy d ON w.symbol = d.symbol AND w.session_date = d.session_date"))
def j02(spark, sf):
    d = price_panel(spark, sf, "day").select("symbol", "session_date", r("close", 8).alias("day_close"))
    return week(spark, sf).select("symbol", "session_date", r("close", 8).alias("week_close")).join(d, ["symbol", "session_date"])


@query("j04_full_outer", sql("SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.session_date, b.session_date) AS session_date, coalesce(a.n, 0) AS n_high, coalesce(b.n, 0) AS n_low FROM (SELECT symbol, session_date, n FROM ev WHERE n > 60) a FULL JOIN (SELECT symbol, session_date, n FROM ev WHERE n <= 70) b ON a.symbol = b.symbol AND a.session_date = b.session_date"))
def j04(spark, sf):
    ev = event_panel(spark, sf).select("symbol", "session_date", "n")
    both = ev.where("n > 60").withColumnRenamed("n", "n_high").join(ev.where("n <= 70").withColumnRenamed("n", "n_low"), ["symbol", "session_date"], "full")
    return both.select("symbol", "session_date", F.coalesce("n_high", F.lit(0)).alias("n_high"), F.coalesce("n_low", F.lit(0)).alias("n_low"))


@query("j05_left_with_null_count", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey IS NULL) AS unmatched FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def j05(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("unmatched"))


@query("j06_as_of", sql("SELECT o.o_orderkey, c.session_date FROM orders o ASOF JOIN cal c ON CAST(o.o_orderdate AS DATE) >= c.session_date"))
def j06(spark, sf):
    cal = calendar.build(week(spark, sf))
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return orders.join(calendar.neighbours(orders.select("day").distinct(), cal), "day").where("at_or_before is not null").select("o_orderkey", F.col("at_or_before").alias("session_date"))


@query("j08_interval_join", sql("SELECT w.symbol, w.session_date, f.reason FROM wk w JOIN (SELECT symbol, min(session_date) + 70 AS a, min(session_date) + 140 AS b, 'early' AS reason FROM wk GROUP BY symbol) f ON w.symbol = f.symbol AND w.session_date BETWEEN f.a AND f.b"))
def j08(spark, sf):
    from pitwright.operators.adjust import flagged

    panel = week(spark, sf)
    flags = panel.groupBy("symbol").agg(F.min("session_date").alias("m")).select("symbol", F.date_add("m", 70).alias("start_date"), F.date_add("m", 140).alias("end_date"), F.lit("early").alias("reason"))
    return flagged(panel, flags).select("symbol", "session_date", "reason")


@query("j09_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j09(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("j11_adjacent_session", sql("SELECT d.symbol, d.session_date, round(p.close, 8) AS prior_close FROM (SELECT dy.*, session_idx FROM dy JOIN dcal USING (session_date)) d JOIN (SELECT dy.symbol, dy.close, session_idx FROM dy JOIN dcal USING (session_date)) p ON d.symbol = p.symbol AND d.session_idx = p.session_idx + 1"))
def j11(spark, sf):
    panel = price_panel(spark, sf, "day")
    numbered = panel.join(calendar.build(panel), "session_date")
    before = numbered.select("symbol", (F.col("session_idx") + 1).alias("session_idx"), r("close", 8).alias("prior_close"))
    return numbered.select("symbol", "session_date", "session_idx").join(before, ["symbol", "session_idx"]).drop("session_idx")


@query("j13_pairwise_series", sql("SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.r, b.r), 6) AS correlation FROM (SELECT symbol, session_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS r FROM wk) a JOIN (SELECT symbol, session_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS r FROM wk) b ON a.session_date = b.session_date AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 21"))
def j13(spark, sf):
    from pitwright.operators.evaluate import correlations

    series = features.with_returns(week(spark, sf)).where("ret is not null").select("session_date", F.col("symbol").alias("name"), "ret")
    return correlations(series).withColumn("correlation", r("correlation"))


# Aggregations


@query("e01_median_count", sql("SELECT symbol, round(median(turnover_inr), 4) AS median_turnover, count(*) AS n FROM wk GROUP BY symbol"))
def e01(spark, sf):
    return week(spark, sf).groupBy("symbol").agg(r(F.median("turnover_inr"), 4).alias("median_turnover"), F.count("*").alias("n"))


@query("e04_weighted_mean", sql("SELECT session_date, round(sum((close / open - 1) * turnover_inr) / sum(turnover_inr), 6) AS weighted, round(avg(close / open - 1), 6) AS equal FROM wk GROUP BY session_date"))
def e04(spark, sf):
    x, v = F.col("close") / F.col("open") - 1, F.col("turnover_inr")
    return week(spark, sf).groupBy("session_date").agg(r(F.sum(x * v) / F.sum(v)).alias("weighted"), r(F.avg(x)).alias("equal"))


@query("e08_global_extent", sql("SELECT min(session_date) AS first, max(session_date) AS last, count(DISTINCT symbol) AS symbols, count(*) FILTER (WHERE close IS NULL) AS nulls FROM wk"))
def e08(spark, sf):
    return week(spark, sf).agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"), F.count_distinct("symbol").alias("symbols"), F.count_if(F.col("close").isNull()).alias("nulls"))


@query("e09_distinct_pairs", "SELECT count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem")
def e09(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"))


@query("e10_last_close", sql("SELECT symbol, round(max_by(close, session_date), 8) AS last_close FROM wk GROUP BY symbol"))
def e10(spark, sf):
    return week(spark, sf).groupBy("symbol").agg(r(F.max_by("close", "session_date"), 8).alias("last_close"))


@query("e17_describe", sql("SELECT symbol, count(*) AS n, round(median(volume), 4) AS median, round(avg(volume), 4) AS mean, round(quantile_cont(volume, 0.1), 4) AS p10, round(quantile_cont(volume, 0.9), 4) AS p90, round(stddev_samp(volume), 4) AS sd FROM wk GROUP BY symbol"))
def e17(spark, sf):
    v = "volume"
    return week(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), r(F.median(v), 4).alias("median"), r(F.avg(v), 4).alias("mean"), r(F.percentile(v, 0.1), 4).alias("p10"), r(F.percentile(v, 0.9), 4).alias("p90"), r(F.stddev_samp(v), 4).alias("sd"))


@query("e19_confusion", "SELECT a, b, coalesce(n, 0) AS n FROM (SELECT unnest(['0', '1', '2']) AS a) JOIN (SELECT unnest(['0', '1', '2']) AS b) ON true LEFT JOIN (SELECT CAST(quality AS VARCHAR) AS a, CAST(toxic AS VARCHAR) AS b, count(*) AS n FROM labels GROUP BY 1, 2) USING (a, b)")
def e19(spark, sf):
    from pitwright.operators.evaluate import confusion

    return confusion(table(spark, sf, "labels"), ["0", "1", "2"], "quality", "toxic")


@query("e21_rates_by_year", "SELECT year(o_orderdate) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS changed, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM orders GROUP BY ROLLUP (year(o_orderdate))")
def e21(spark, sf):
    f = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").rollup(F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count_if(f).alias("changed"), F.count("*").alias("n"), r(F.avg(f.cast("double"))).alias("rate"))


@query("e23_moments", sql("SELECT symbol, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, round((avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * avg(r) ** 3) / stddev_pop(r) ** 3, 4) AS skew, round(avg(CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS r FROM wk) WHERE r IS NOT NULL GROUP BY symbol"))
def e23(spark, sf):
    from pitwright.functions.statistics import moments

    return moments(features.with_returns(week(spark, sf)), ["symbol"], "ret").select("symbol", "n", r("mean").alias("mean"), r("sd").alias("sd"), r("skew", 4).alias("skew"), r("zero_share").alias("zero_share"))


# Windows


@query("w01_lag_own_quotations", sql("SELECT symbol, session_date, round(lag(close) OVER w, 8) AS prior_close, lag(session_date) OVER w AS prior_date FROM dy WINDOW w AS (PARTITION BY symbol ORDER BY session_date)"))
def w01(spark, sf):
    return price_panel(spark, sf, "day").select("symbol", "session_date", r(features.lagged("close"), 8).alias("prior_close"), features.lagged("session_date").alias("prior_date"))


@query("w04_trailing_mean", sql("SELECT symbol, session_date, round(CASE WHEN count(turnover_inr) OVER w = 21 THEN avg(turnover_inr) OVER w END, 4) AS adv FROM wk WINDOW w AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)"))
def w04(spark, sf):
    return week(spark, sf).select("symbol", "session_date", r(features.trailing("turnover_inr", 21), 4).alias("adv"))


@query("w06_trailing_with_minimum", sql("SELECT symbol, session_date, round(CASE WHEN count(volume) OVER w >= 5 THEN avg(volume) OVER w END, 4) AS mean FROM wk WINDOW w AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"))
def w06(spark, sf):
    return week(spark, sf).select("symbol", "session_date", r(features.trailing("volume", 10, at_least=5), 4).alias("mean"))


@query("w13_last_sessions", sql("SELECT symbol, session_date FROM wk WHERE session_date IN (SELECT DISTINCT session_date FROM wk ORDER BY session_date DESC LIMIT 5)"))
def w13(spark, sf):
    return features.last_sessions(week(spark, sf), 5).select("symbol", "session_date")


@query("w15_drawdown", sql("SELECT symbol, session_date, round(e / greatest(1.0, max(e) OVER (PARTITION BY symbol ORDER BY session_date)) - 1, 6) AS drawdown FROM (SELECT symbol, session_date, exp(sum(ln(1 + (r / 100))) OVER (PARTITION BY symbol ORDER BY session_date)) AS e FROM (SELECT symbol, session_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS r FROM wk) WHERE r IS NOT NULL AND r < 50)"))
def w15(spark, sf):
    from pitwright.operators.metrics import equity_curve

    rows = features.with_returns(week(spark, sf)).where("ret < 50").withColumn("ret", F.col("ret") / 100)
    return equity_curve(rows, "symbol").select("symbol", "session_date", r("drawdown").alias("drawdown"))


@query("w16_runs", sql("SELECT min(session_date) AS start, max(session_date) AS \"end\", up, count(*) AS n FROM (SELECT *, sum(changed) OVER (ORDER BY session_date) AS run FROM (SELECT session_date, net > 0 AS up, CASE WHEN (net > 0) IS DISTINCT FROM lag(net > 0) OVER (ORDER BY session_date) THEN 1 ELSE 0 END AS changed FROM net)) GROUP BY run, up"))
def w16(spark, sf):
    order = W.orderBy("session_date")
    rows = net_flow(spark, sf).withColumn("up", F.col("net") > 0)
    rows = rows.withColumn("changed", (~F.col("up").eqNullSafe(F.lag("up").over(order))).cast("int")).withColumn("run", F.sum("changed").over(order))
    return rows.groupBy("run", "up").agg(F.min("session_date").alias("start"), F.max("session_date").alias("end"), F.count("*").alias("n")).drop("run")


@query("w20_rebalance_dates", sql("SELECT min(session_date) AS rebalance_date FROM cal GROUP BY date_trunc('quarter', session_date)"))
def w20(spark, sf):
    return calendar.rebalance_dates(calendar.build(week(spark, sf)))


@query("w21_ema", sql("SELECT symbol, session_date, round(ema, 4) AS ema FROM rec", "s AS (SELECT symbol, session_date, close, row_number() OVER (PARTITION BY symbol ORDER BY session_date) AS i FROM wk), rec AS (SELECT symbol, session_date, i, close AS ema FROM s WHERE i = 1 UNION ALL SELECT s.symbol, s.session_date, s.i, 0.2 * s.close + 0.8 * rec.ema FROM rec JOIN s ON s.symbol = rec.symbol AND s.i = rec.i + 1)").replace("WITH", "WITH RECURSIVE", 1))
def w21(spark, sf):
    return features.ema(week(spark, sf), 0.2).withColumn("ema", r("ema", 4))


# Order, top, sets


@query("t02_worst", sql("SELECT symbol, session_date, move FROM (SELECT symbol, session_date, round(abs(close / open - 1), 6) AS move, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(close / open - 1), 6) DESC, session_date) AS k FROM wk) WHERE k <= 3 ORDER BY move DESC, symbol, session_date LIMIT 15"))
def t02(spark, sf):
    rows = week(spark, sf).withColumn("move", r(F.abs(F.col("close") / F.col("open") - 1)))
    best = rows.withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("move"), "session_date"))).where("k <= 3")
    return best.orderBy(F.desc("move"), "symbol", "session_date").limit(15).select("symbol", "session_date", "move")


@query("t04_top_n", sql("SELECT session_date, symbol FROM (SELECT session_date, symbol, row_number() OVER (PARTITION BY session_date ORDER BY turnover_inr DESC, symbol) AS k FROM wk) WHERE k <= 3"))
def t04(spark, sf):
    place = F.row_number().over(W.partitionBy("session_date").orderBy(F.desc("turnover_inr"), "symbol"))
    return week(spark, sf).withColumn("k", place).where("k <= 3").select("session_date", "symbol")


@query("t07_every_nth", sql("SELECT session_date FROM cal WHERE session_idx % 4 = 0"))
def t07(spark, sf):
    return calendar.every_nth(calendar.build(week(spark, sf)), 4).select("session_date")


@query("t08_best_of_blocks", "SELECT o_orderkey // 50 AS block, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS idx, round(max(o_totalprice), 4) AS score FROM orders GROUP BY 1")
def t08(spark, sf):
    from pitwright.operators.evaluate import best_of_blocks

    trials = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("score"))
    return best_of_blocks(trials, 50).withColumn("score", r("score", 4))


@query("u01_union_all", "SELECT CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def u01(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").cast("bigint").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("u03_intersect_except", "SELECT k, 'both' AS kind FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customers only' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def u03(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("kind", F.lit("both")).unionByName(c.subtract(s).withColumn("kind", F.lit("customers only")))


@query("u04_unpivot", sql("SELECT symbol, session_date, measure, round(value, 8) AS value FROM (SELECT symbol, session_date, open, high, low, close FROM wk) UNPIVOT (value FOR measure IN (open, high, low, close))"))
def u04(spark, sf):
    return week(spark, sf).unpivot(["symbol", "session_date"], ["open", "high", "low", "close"], "measure", "value").withColumn("value", r("value", 8))


@query("u05_pivot", sql("SELECT session_date, sum(n) FILTER (WHERE symbol = 'click')::BIGINT AS click, sum(n) FILTER (WHERE symbol = 'purchase')::BIGINT AS purchase, sum(n) FILTER (WHERE symbol = 'error')::BIGINT AS error FROM ev GROUP BY session_date"))
def u05(spark, sf):
    return event_panel(spark, sf).groupBy("session_date").pivot("symbol", ["click", "purchase", "error"]).agg(F.sum("n"))


@query("u06_densify", sql("SELECT s.symbol, c.session_date, round(w.close, 8) AS close FROM (SELECT DISTINCT symbol FROM wk) s CROSS JOIN cal c LEFT JOIN wk w ON w.symbol = s.symbol AND w.session_date = c.session_date"))
def u06(spark, sf):
    panel = week(spark, sf)
    grid = panel.select("symbol").distinct().crossJoin(calendar.build(panel).select("session_date"))
    return grid.join(panel.select("symbol", "session_date", r("close", 8).alias("close")), ["symbol", "session_date"], "left")


# Scalar functions


@query("f02_transcendental", "SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 9) AS a, round(exp(-l_tax), 9) AS b, round(sqrt(l_extendedprice), 6) AS c, round(log10(l_quantity), 9) AS d, round(l_discount ** 1.5, 9) AS e FROM lineitem")
def f02(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(F.ln(q), 9).alias("a"), r(F.exp(-F.col("l_tax")), 9).alias("b"), r(F.sqrt("l_extendedprice"), 6).alias("c"), r(F.log10(q), 9).alias("d"), r(F.pow("l_discount", F.lit(1.5)), 9).alias("e"))


@query("f05_strings", "SELECT p_partkey, lower(trim(p_name)) AS name, starts_with(p_type, 'PROMO') AS promo, replace(p_brand, '#', '-') AS brand, length(p_name) AS n FROM part")
def f05(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("name"), F.startswith("p_type", F.lit("PROMO")).alias("promo"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), F.length("p_name").cast("bigint").alias("n"))


@query("f08_calendar_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, isodow(o_orderdate) - 1 AS weekday FROM orders")
def f08(spark, sf):
    d = "o_orderdate"
    return table(spark, sf, "orders").select("o_orderkey", *[f(d).cast("bigint").alias(n) for f, n in ((F.year, "y"), (F.month, "m"), (F.quarter, "q"), (F.weekday, "weekday"))])


@query("f14_digest", "SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR) || '|' || c_name) AS digest FROM customer")
def f14(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name"), 256).alias("digest"))


# Calendar


@query("c01_calendar", sql("SELECT session_date, session_idx FROM cal"))
def c01(spark, sf):
    return calendar.build(week(spark, sf))


@query("c03_neighbours", sql("SELECT d.day, (SELECT max(session_date) FROM cal WHERE session_date < d.day) AS previous, (SELECT min(session_date) FROM cal WHERE session_date > d.day) AS next FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) d"))
def c03(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return calendar.neighbours(days, calendar.build(week(spark, sf))).select("day", "previous", "next")


@query("c04_shift", sql("SELECT a.session_date AS day, b.session_date AS shifted FROM cal a LEFT JOIN cal b ON b.session_idx = a.session_idx - 3"))
def c04(spark, sf):
    cal = calendar.build(week(spark, sf))
    return calendar.shift(cal.select(F.col("session_date").alias("day")), cal, -3, strict=False)


@query("c05_sessions_between", sql("SELECT session_date, session_idx FROM cal WHERE session_date BETWEEN DATE '1994-01-01' AND DATE '1994-12-31'"))
def c05(spark, sf):
    return calendar.between(calendar.build(week(spark, sf)), "1994-01-01", "1994-12-31")


@query("c07_missing_sessions", sql("SELECT session_date FROM dcal WHERE session_date NOT IN (SELECT session_date FROM dy WHERE symbol = 'Brand#11') AND session_date BETWEEN (SELECT min(session_date) FROM dy WHERE symbol = 'Brand#11') AND (SELECT max(session_date) FROM dy WHERE symbol = 'Brand#11')"))
def c07(spark, sf):
    panel = price_panel(spark, sf, "day")
    return calendar.missing_sessions(panel.where("symbol = 'Brand#11'"), calendar.build(panel))
