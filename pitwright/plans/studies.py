"""Backtest records, data quality, corpus studies and stress over paths, each as a query of its own."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.functions import normal, statistics
from pitwright.operators import adjust, backtest, calendar, capacity, costs, evaluate, features, stress, studies, universe
from pitwright.plans import domain
from pitwright.plans.domain import CAPACITY, COSTS, GROSS, MEASURES, MOMENTUM, RET, UNIVERSE, book, legs, momentum_run, momentum_scores, ranks
from pitwright.plans.inventory import DRET, FLAGS, OVER, behind, day, drawn, flags, paths_sql
from pitwright.plans.relational import ORACLES, QUERIES, query, r, sql, week
from pitwright.sources import files
from pitwright.sources.panels import event_panel, table

__all__ = ["ORACLES", "QUERIES"]

EARLY = (dataclasses.replace(costs.SCHEDULE[0], effective_from="1990-01-01"), *costs.SCHEDULE[1:])


def recursive(text: str) -> str:
    return text.replace("WITH", "WITH RECURSIVE", 1)


# Universe, view and records of a backtest

MEMBERS = f"{UNIVERSE}, un AS (SELECT rebalance_date, symbol FROM elig WHERE rank <= 8), mem AS (SELECT cal.session_date, un.symbol, un.rebalance_date FROM cal JOIN un ON un.rebalance_date = (SELECT max(rebalance_date) FROM un u WHERE u.rebalance_date <= cal.session_date))"


def members(spark, sf):
    return universe.membership(calendar.build(week(spark, sf)), ranks(spark, sf).where("rank <= 8"))


@query("b01_daily_universe", sql("SELECT session_date, symbol, rebalance_date FROM mem", MEMBERS))
def b01(spark, sf):
    return members(spark, sf)


@query("b02_view", sql("SELECT symbol, session_date, close FROM wk WHERE session_date < DATE '1996-01-01' AND symbol IN (SELECT symbol FROM mem WHERE session_date = DATE '1996-01-01') AND session_date IN (SELECT DISTINCT session_date FROM wk WHERE session_date < DATE '1996-01-01' AND symbol IN (SELECT symbol FROM mem WHERE session_date = DATE '1996-01-01') ORDER BY 1 DESC LIMIT 30)", MEMBERS))
def b02(spark, sf):
    return features.view(week(spark, sf), members(spark, sf), "1996-01-01", 30).select("symbol", "session_date", "close")


@query("b03_signals", sql("SELECT session_date AS decision_session, session_date AS information_at, fill AS session_date, n FROM (SELECT session_date, lead(session_date) OVER (ORDER BY session_date) AS fill FROM cal) JOIN (SELECT session_date, count(*) AS n FROM book GROUP BY 1) USING (session_date) WHERE fill IS NOT NULL", MOMENTUM))
def b03(spark, sf):
    panel = week(spark, sf)
    fills = calendar.build(panel).withColumn("fill", F.lead("session_date").over(W.orderBy("session_date"))).where("fill is not null")
    decided = book(panel).groupBy("session_date").agg(F.count("*").alias("n")).join(fills.select("session_date", "fill"), "session_date")
    return backtest.validate_signals(decided.select(F.col("session_date").alias("decision_session"), F.col("session_date").alias("information_at"), F.col("fill").alias("session_date"), "n"))


@query("b05_turnover", sql("SELECT session_date, round(sum(abs(w - p)), 9) AS turnover, count(*) FILTER (WHERE p = 0) AS entries, count(*) FILTER (WHERE NOT held) AS exits FROM mv GROUP BY 1", GROSS))
def b05(spark, sf):
    weights, fills, _, _ = momentum_run(spark, sf)
    moved = backtest.changes(weights, fills)
    return moved.groupBy("session_date").agg(r(F.sum(F.abs(F.col("weight") - F.col("previous"))), 9).alias("turnover"), F.count_if(F.col("previous") == 0).alias("entries"), F.count_if(~F.col("held")).alias("exits"))


#: Equity of the money that is left: a fold over sessions, which SQL can only recurse.
NET = f"""{GROSS},
lg AS (SELECT acc.session_date, abs(w - p) AS d, coalesce(wk.turnover_inr, 0) AS v, w < p AS sells, 0.001::DOUBLE + CASE WHEN w < p THEN 0 ELSE 0.00015::DOUBLE END + (0.0000325::DOUBLE + 0.000002::DOUBLE) * 1.18::DOUBLE AS rate FROM acc LEFT JOIN wk ON wk.symbol = acc.symbol AND wk.session_date = acc.session_date WHERE w <> p),
days AS (SELECT g.session_date, g.g, g.x, g.t, row_number() OVER (ORDER BY g.session_date) AS i, (SELECT list({{'d': d, 'v': v, 'sells': sells, 'rate': rate}}) FROM lg WHERE lg.session_date = g.session_date) AS legs FROM gross g),
run AS (SELECT 0::BIGINT AS i, NULL::DATE AS session_date, 0::DOUBLE AS g, 0::DOUBLE AS x, 0::DOUBLE AS t, 0::DOUBLE AS cost, 1000000.0::DOUBLE AS equity
  UNION ALL SELECT i, session_date, g, x, t, cost, before * (1 + g - cost) FROM (SELECT days.i, days.session_date, days.g, days.x, days.t, run.equity AS before,
    coalesce(list_sum(list_transform(days.legs, lambda l: l.d * (l.rate + CASE WHEN l.v > 0 THEN least(0.1::DOUBLE * l.d * run.equity / l.v, 0.05::DOUBLE) ELSE 0.05::DOUBLE END + CASE WHEN l.v > 0 THEN 0.02::DOUBLE * sqrt(l.d * run.equity / l.v) ELSE 0 END) + CASE WHEN l.sells THEN 15.34::DOUBLE / run.equity ELSE 0 END)), 0) AS cost
    FROM run JOIN days ON days.i = run.i + 1 WHERE run.equity > 0))"""


@query("b07_net_backtest", recursive(sql("SELECT session_date, round(g, 5) AS gross_return, round(x, 6) AS gross_exposure, round(t, 6) AS turnover, round(cost, 5) AS cost, round(g - cost, 5) AS net_return, equity > 0 AS solvent FROM run WHERE i > 0", NET)))
def b07(spark, sf):
    # The test tables are older than the first rates.
    out = backtest.net(*momentum_run(spark, sf), depository=costs.DEPOSITORY, schedule=EARLY)
    return out.select("session_date", r("gross_return", 5).alias("gross_return"), r("gross_exposure").alias("gross_exposure"), r("turnover").alias("turnover"), r("cost", 5).alias("cost"), r("net_return", 5).alias("net_return"), (F.col("equity") > 0).alias("solvent"))


LEVERED = f"{RET}, eq AS (SELECT symbol, session_date, product(1 + greatest(-1.5::DOUBLE, least(1.0::DOUBLE, ret)) * 0.7::DOUBLE) {OVER} AS equity FROM ret WHERE ret IS NOT NULL), worse AS (SELECT symbol, session_date, equity - 0.5::DOUBLE * row_number() {OVER} / 20 AS equity FROM eq)"


def levered(spark, sf):
    x = F.greatest(F.lit(-1.5), F.least(F.lit(1.0), F.col("ret"))) * 0.7
    rows = features.with_returns(week(spark, sf)).where("ret is not null")
    rows = rows.withColumn("equity", F.product(1 + x).over(features.by_symbol().rowsBetween(W.unboundedPreceding, 0)) - F.row_number().over(features.by_symbol()) * 0.5 / 20)
    return rows.select(F.col("symbol").alias("strategy"), "session_date", "equity")


@query("b08_ruin", sql("SELECT symbol AS strategy, session_date FROM worse w WHERE session_date <= coalesce((SELECT min(session_date) FROM worse x WHERE x.symbol = w.symbol AND x.equity <= 0), DATE '9999-01-01')", LEVERED))
def b08(spark, sf):
    return backtest.until_ruin(levered(spark, sf)).select("strategy", "session_date")


@query("b09_rebalance_cost", sql("SELECT session_date, round(sum(d * (rate + CASE WHEN v > 0 THEN least(0.1::DOUBLE * d * 1e6 / v, 0.05::DOUBLE) + 0.02::DOUBLE * sqrt(d * 1e6 / v) ELSE 0.05::DOUBLE END) + CASE WHEN sells THEN 15.34::DOUBLE / 1e6 ELSE 0 END), 6) AS cost, count(*) AS legs FROM lg GROUP BY 1", NET))
def b09(spark, sf):
    weights, fills, prices, _ = momentum_run(spark, sf)
    return backtest.rebalance_costs(weights, fills, prices, 1_000_000.0, depository=costs.DEPOSITORY, schedule=EARLY).groupBy("session_date").agg(r(F.sum("share")).alias("cost"), F.count("*").alias("legs"))


@query("b10_breaches", sql("SELECT mv.session_date, mv.symbol, round(abs(w - p) * 1e6 / turnover_inr, 6) AS participation FROM mv JOIN wk USING (session_date, symbol) WHERE turnover_inr > 0 AND abs(w - p) * 1e6 / turnover_inr > 25", GROSS))
def b10(spark, sf):
    weights, fills, prices, _ = momentum_run(spark, sf)
    flat = fills.withColumn("equity", F.lit(1_000_000.0))
    return backtest.breaches(weights, fills, prices, flat, limit=25.0).select("session_date", "symbol", r("participation").alias("participation"))


@query("b11_flagged_holdings", sql("SELECT session_date, symbol, reason FROM tgt JOIN fl USING (symbol) WHERE session_date BETWEEN a AND b", f"{GROSS}, {FLAGS}"))
def b11(spark, sf):
    return backtest.flagged_holdings(momentum_run(spark, sf)[0], flags(spark, sf)).select("session_date", "symbol", "reason")


@query("b12_positions", sql("SELECT session_date, count(*) AS names, round(sum(abs(weight)), 6) AS gross, round(sum(weight), 6) AS net, round(max(abs(weight)), 6) AS largest FROM tgt GROUP BY 1", GROSS))
def b12(spark, sf):
    weights, _, panel, _ = momentum_run(spark, sf)
    out = backtest.positions(backtest.clamp(weights, weights))
    return out.select("session_date", "names", *[r(c).alias(c) for c in ("gross", "net", "largest")])


@query("b14_slippage", sql("SELECT o_orderkey, round(t * least(0.1::DOUBLE * t / v, 0.05::DOUBLE), 8) AS slippage FROM rated", COSTS))
def b14(spark, sf):
    return legs(spark, sf).select("o_orderkey", r(costs.slippage(F.col("turnover"), F.col("traded_value")), 8).alias("slippage"))


@query("b15_impact", sql("SELECT o_orderkey, round(t * 0.03::DOUBLE * sqrt(t / v), 8) AS impact FROM rated", COSTS))
def b15(spark, sf):
    return legs(spark, sf).select("o_orderkey", r(costs.impact(F.col("turnover"), F.col("traded_value"), F.lit(0.03)), 8).alias("impact"))


@query("b17_average_daily_value", sql("SELECT symbol, session_date, round(close * volume / avg(close * volume) OVER (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), 6) AS relative FROM dy"))
def b17(spark, sf):
    panel = day(spark, sf)
    return panel.select("symbol", "session_date", r(F.col("close") * F.col("volume") / studies.adv(panel, 21)).alias("relative"))


RESULTS = f"{RET}, res AS (SELECT symbol AS strategy, session_date, greatest(-0.5::DOUBLE, least(0.5::DOUBLE, ret)) / 50 AS g, greatest(-0.5::DOUBLE, least(0.5::DOUBLE, ret)) / 50 - 0.0045::DOUBLE AS n FROM ret WHERE ret IS NOT NULL), sh AS (SELECT strategy, avg(g) / stddev_samp(g) * sqrt(252) AS gs, avg(n) / stddev_samp(n) * sqrt(252) AS ns FROM res GROUP BY 1)"


def results(spark, sf):
    g = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("ret"))) / 50
    return features.with_returns(week(spark, sf)).where("ret is not null").select(F.col("symbol").alias("strategy"), "session_date", g.alias("gross_return"), (g - 0.0045).alias("net_return"), F.lit(1.0).alias("equity"))


@query("b21_gross_against_net", sql("SELECT strategy, round(gs, 6) AS gross_sharpe, round(ns, 6) AS net_sharpe, round(gs - ns, 6) AS drop, gs > 0 AND ns <= 0 AS flipped FROM sh", RESULTS))
def b21(spark, sf):
    out = studies.gross_against_net(results(spark, sf))
    return out.select("strategy", *[r(c).alias(c) for c in ("gross_sharpe", "net_sharpe", "drop")], "flipped")


@query("b22_depository_sensitivity", sql("SELECT scheme, book_size AS book, round(avg_n * charge / book_size, 9) AS share FROM (SELECT avg(n) AS avg_n FROM (SELECT session_date, count(*) FILTER (WHERE w < p) AS n FROM mv GROUP BY 1)), (VALUES ('none', 0.0::DOUBLE), ('research', 3.5::DOUBLE), ('retail', 15.34::DOUBLE)) s(scheme, charge), (VALUES (1e5::DOUBLE), (1e6::DOUBLE), (1e7::DOUBLE)) b(book_size)", GROSS))
def b22(spark, sf):
    weights, fills, _, _ = momentum_run(spark, sf)
    changes = backtest.changes(weights, fills).withColumn("change", F.col("weight") - F.col("previous"))
    return studies.depository_sensitivity(changes, {"none": 0.0, "research": 3.5, "retail": 15.34}, [1e5, 1e6, 1e7]).withColumn("share", r("share", 9))


# Universe history and data quality


@query(
    "d05_universe_history",
    recursive(
        sql(
            "SELECT rebalance_date, n.symbol AS symbol, CAST(n.rank AS INT) AS rank FROM (SELECT rebalance_date, unnest(chosen) AS n FROM hist WHERE i > 0)",
            f"""{UNIVERSE}, lists AS (SELECT rebalance_date, list({{'rank': rank, 'symbol': symbol}} ORDER BY rank) AS names, row_number() OVER (ORDER BY rebalance_date) AS i FROM elig GROUP BY 1),
            hist AS (SELECT 0::BIGINT AS i, NULL::DATE AS rebalance_date, []::STRUCT("class" INT, rank BIGINT, symbol VARCHAR)[] AS chosen
              UNION ALL SELECT l.i, l.rebalance_date, list_sort(list_transform(l.names, lambda n: {{'class': CASE WHEN list_contains(list_transform(h.chosen, lambda c: c.symbol), n.symbol) AND n.rank <= 7 THEN 0 WHEN NOT list_contains(list_transform(h.chosen, lambda c: c.symbol), n.symbol) AND n.rank <= 4 THEN 1 ELSE 2 END, 'rank': n.rank, 'symbol': n.symbol}}))[1:5] FROM hist h JOIN lists l ON l.i = h.i + 1)""",
        )
    ),
)
def d05(spark, sf):
    return universe.history(ranks(spark, sf), size=5, entry=4, exit=7)


DECLARED = "de AS (SELECT symbol, session_date AS ex_date, 1.0::DOUBLE + (session_idx % 3) / 2.0::DOUBLE AS factor FROM wk JOIN cal USING (session_date) WHERE session_idx % 20 = 7), ob AS (SELECT de.*, p.close / w.open AS observed FROM de JOIN wk w ON w.symbol = de.symbol AND w.session_date = ex_date JOIN cal c ON c.session_date = ex_date JOIN cal d ON d.session_idx = c.session_idx - 1 JOIN wk p ON p.symbol = de.symbol AND p.session_date = d.session_date WHERE w.open > 0 AND p.close > 0)"


def reconciled(spark, sf):
    panel = week(spark, sf)
    cal = calendar.build(panel)
    declared = panel.join(cal, "session_date").where("session_idx % 20 = 7").select("symbol", F.col("session_date").alias("ex_date"), (1.0 + (F.col("session_idx") % 3) / 2.0).alias("factor"))
    return adjust.reconcile(declared, panel, cal)


@query("d08_reconcile", sql("SELECT symbol, ex_date, factor, round(observed, 6) AS observed, abs(observed / factor - 1) <= 0.1 AS agrees FROM ob", DECLARED))
def d08(spark, sf):
    return reconciled(spark, sf).withColumn("observed", r("observed"))


FACTORS = "nf AS (SELECT unnest([" + ", ".join(repr(f) for f in [*adjust.conventional_factors(), *[1 / f for f in adjust.conventional_factors()]]) + "]::DOUBLE[]) AS f), sn AS (SELECT symbol, ex_date, observed, min_by(f, (abs(observed - f) / f, f)) AS f, min(abs(observed - f) / f) AS gap FROM ob, nf GROUP BY ALL)"


@query("d09_snap", sql("SELECT symbol, ex_date, CASE WHEN gap <= 0.05 THEN f END AS snapped FROM sn", f"{DECLARED}, {FACTORS}"))
def d09(spark, sf):
    return adjust.snap(reconciled(spark, sf)).select("symbol", "ex_date", "snapped")


@query("d10_resolve", sql("SELECT symbol, ex_date, CASE WHEN abs(observed - 1) <= 0.05 THEN 'no_adjustment' WHEN gap <= 0.05 THEN 'snapped' ELSE 'unresolved' END AS decision, CASE WHEN abs(observed - 1) <= 0.05 THEN 1.0::DOUBLE WHEN gap <= 0.05 THEN f END AS final_factor FROM sn", f"{DECLARED}, {FACTORS}"))
def d10(spark, sf):
    return adjust.resolve(reconciled(spark, sf)).select("symbol", "ex_date", "decision", "final_factor")


@query("d13_register", sql("SELECT symbol, a AS start_date, b AS end_date, reason FROM fl UNION SELECT symbol, ex_date, ex_date, 'unresolved_factor' FROM sn WHERE NOT (abs(observed - 1) <= 0.05 OR gap <= 0.05)", f"{FLAGS}, {DECLARED}, {FACTORS}"))
def d13(spark, sf):
    unresolved = adjust.resolve(reconciled(spark, sf)).where("decision = 'unresolved'")
    return adjust.register(flags(spark, sf).withColumn("detail", F.lit("")), unresolved).select("symbol", "start_date", "end_date", "reason")


BASKETS = "bk AS (SELECT session_date, avg(ret) AS e, sum(ret * w) / sum(w) AS t FROM (SELECT *, lag(turnover_inr) OVER (PARTITION BY symbol ORDER BY session_date) AS w FROM ret) WHERE ret IS NOT NULL AND w IS NOT NULL GROUP BY 1), ixr AS (SELECT session_date, c / lag(c) OVER (ORDER BY session_date) - 1 AS r FROM (SELECT session_date, avg(close) AS c FROM wk GROUP BY 1))"


@query("d14_tracking_error", sql("SELECT round(stddev_samp(r - e) * sqrt(252), 5) AS to_equal_weight, round(stddev_samp(r - t) * sqrt(252), 5) AS to_turnover, round(stddev_samp(e - t) * sqrt(252), 5) AS between, count(*) AS n FROM bk JOIN ixr USING (session_date) WHERE r IS NOT NULL", f"{RET}, {BASKETS}"))
def d14(spark, sf):
    index = domain.index(spark, sf).withColumn("ret", F.try_divide("close", F.lag("close").over(W.orderBy("session_date"))) - 1).where("ret is not null").select("session_date", "ret")
    out = studies.error_decomposition(studies.baskets(week(spark, sf)), index)
    return out.select(*[r(c, 5).alias(c) for c in ("to_equal_weight", "to_turnover", "between")], "n")


@query("d15_timeline", "SELECT n_name AS title, DATE '2020-01-01' + n_nationkey AS announced_date, DATE '2020-02-01' + n_nationkey AS effective_date FROM nation")
def d15(spark, sf):
    n = F.col("n_nationkey").cast("int")
    start = lambda d: F.date_add(F.lit(d).cast("date"), n)
    rows = table(spark, sf, "nation").select(start("2020-01-01").alias("announced_date"), start("2020-02-01").alias("effective_date"), F.lit("rule").alias("category"), F.col("n_name").alias("title"), F.lit("d").alias("description"), F.lit("https://a").alias("source_url"))
    return files.validate_events(rows).select("title", "announced_date", "effective_date")


# Statistics of a corpus

MOMENTS = f"{RET}, mo AS (SELECT symbol, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, avg(ret) / stddev_samp(ret) AS sharpe, (avg(ret ** 3) - 3 * avg(ret) * avg(ret ** 2) + 2 * avg(ret) ** 3) / stddev_pop(ret) ** 3 AS skew, (avg(ret ** 4) - 4 * avg(ret) * avg(ret ** 3) + 6 * avg(ret) ** 2 * avg(ret ** 2) - 3 * avg(ret) ** 4) / stddev_pop(ret) ** 4 AS kurt FROM ret WHERE ret IS NOT NULL GROUP BY 1)"


def deflated(trials: str) -> str:
    """The luck threshold by halving an interval sixty times, since SQL has no inverse of the normal distribution."""
    inverse = lambda p: f"(SELECT (lo + hi) / 2 FROM bi WHERE i = 60 AND p = {p})"
    return f"""{MOMENTS}, agg AS (SELECT var_samp(sharpe) AS v, {trials} AS k FROM mo),
    bi AS (SELECT 0 AS i, p, -10.0::DOUBLE AS lo, 10.0::DOUBLE AS hi, 1 - 1 / (k * CASE WHEN p = 1 THEN 1 ELSE {math.e!r}::DOUBLE END) AS target FROM agg, (VALUES (1), (2)) t(p)
      UNION ALL SELECT i + 1, p, CASE WHEN {normal.cdf_sql('((lo + hi) / 2)')} < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {normal.cdf_sql('((lo + hi) / 2)')} < target THEN hi ELSE (lo + hi) / 2 END, target FROM bi WHERE i < 60),
    th AS (SELECT sqrt(v) * ((1 - {statistics.EULER!r}::DOUBLE) * {inverse(1)} + {statistics.EULER!r}::DOUBLE * {inverse(2)}) AS threshold FROM agg),
    zs AS (SELECT mo.*, threshold, sharpe / se AS z0, (sharpe - threshold) / se AS z1 FROM (SELECT *, sqrt((1 - skew * sharpe + (kurt - 1) / 4 * sharpe ** 2) / (n - 1)) AS se FROM mo) mo, th)"""


def series(spark, sf):
    return features.with_returns(week(spark, sf)).where("ret is not null").select(F.col("symbol").alias("strategy"), "session_date", "ret")


@query("a01_luck_threshold", recursive(sql("SELECT round(threshold, 8) AS threshold FROM th", deflated("count(*)"))))
def a01(spark, sf):
    return statistics.deflate(statistics.moments(series(spark, sf), ["strategy"], "ret")).select(r("threshold", 8).alias("threshold")).distinct()


@query("a02_deflated_sharpe", recursive(sql(f"SELECT symbol, n, round(sharpe, 8) AS sharpe, round({normal.cdf_sql('z0')}, 7) AS psr, round({normal.cdf_sql('z1')}, 7) AS dsr FROM zs", deflated("count(*)"))))
def a02(spark, sf):
    out = statistics.deflate(statistics.moments(series(spark, sf), ["strategy"], "ret"))
    return out.select(F.col("strategy").alias("symbol"), "n", r("sharpe", 8).alias("sharpe"), r("psr", 7).alias("psr"), r("dsr", 7).alias("dsr"))


@query("a08_statistical_layer", recursive(sql(f"SELECT symbol AS strategy, round({normal.cdf_sql('z1')}, 7) AS dsr, {normal.cdf_sql('z1')} < 0.95 AS rejected FROM zs", deflated("count(*)"))))
def a08(spark, sf):
    return studies.statistical_layer(series(spark, sf)).select("strategy", r("dsr", 7).alias("dsr"), "rejected")


@query("a10_all_trials_counted", recursive(sql(f"SELECT symbol AS strategy, round({normal.cdf_sql('z1')}, 7) AS dsr FROM zs", deflated("500"))))
def a10(spark, sf):
    return studies.statistical_layer(series(spark, sf), trials=500).select("strategy", r("dsr", 7).alias("dsr"))


@query("f04_normal_cdf", f"SELECT l_orderkey, l_linenumber, round({normal.cdf_sql('z')}, 12) AS p FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 4 AS z FROM lineitem)")
def f04(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(normal.cdf((F.col("l_quantity") - 25) / 4), 12).alias("p"))


@query(
    "a03_overfitting",
    sql(
        "SELECT count(*) AS partitions, round(avg((rank / (n + 1) <= 0.5)::INT), 9) AS pbo FROM ranked WHERE place = 1",
        f"""{RET}, rc AS (SELECT symbol, ret, session_idx AS idx FROM (SELECT symbol, ret, row_number() OVER (PARTITION BY 1 ORDER BY 1) AS z, session_date FROM ret WHERE ret IS NOT NULL) JOIN (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS session_idx FROM (SELECT DISTINCT session_date FROM ret WHERE ret IS NOT NULL)) USING (session_date)),
        sums AS (SELECT symbol, CAST(least(floor(idx * 16 / (SELECT max(idx) + 1 FROM rc)), 15) AS INT) AS block, count(*) AS k, sum(ret) AS s, sum(ret * ret) AS q FROM rc GROUP BY 1, 2),
        masks AS (SELECT m FROM range(65536) t(m) WHERE bit_count(m) = 8),
        parts AS (SELECT m, symbol, (m >> block) & 1 AS own, sum(k) AS k, sum(s) AS s, sum(q) AS q FROM sums, masks GROUP BY 1, 2, 3),
        ratios AS (SELECT m, symbol, own, CASE WHEN k > 1 AND (q - s * s / k) / (k - 1) > 1e-24 THEN s / k / sqrt((q - s * s / k) / (k - 1)) ELSE 0.0 END AS ratio FROM parts),
        scored AS (SELECT m, symbol, coalesce(max(ratio) FILTER (WHERE own = 1), 0) AS a, coalesce(max(ratio) FILTER (WHERE own = 0), 0) AS b FROM ratios GROUP BY 1, 2),
        ranked AS (SELECT m, rank() OVER (PARTITION BY m ORDER BY b) + (count(*) OVER (PARTITION BY m, b) - 1) / 2 AS rank, count(*) OVER (PARTITION BY m) AS n, row_number() OVER (PARTITION BY m ORDER BY a DESC, symbol) AS place FROM scored)""",
    ),
)
def a03(spark, sf):
    rows = features.with_returns(week(spark, sf)).where("ret is not null")
    out = evaluate.overfitting(spark, rows.join(calendar.build(rows), "session_date").select(F.col("symbol").alias("strategy"), F.col("session_idx").alias("idx"), "ret"))
    return out.select("partitions", r("pbo", 9).alias("pbo"))


CHAIN = "ch AS (SELECT c_custkey - 1 AS seq, CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE c_name END AS name, 'ok' AS outcome, CASE WHEN c_custkey = 1 THEN '' ELSE sha256('h' || (c_custkey - 2)) END AS prev_hash, sha256('h' || (c_custkey - 1)) AS hash FROM customer WHERE c_custkey % 70 <> 0)"


@query("a04_ledger_problems", f"WITH {CHAIN}, st AS (SELECT *, coalesce(lag(hash) OVER (ORDER BY seq), '') AS before, coalesce(lag(seq) OVER (ORDER BY seq), -1) AS last FROM ch) SELECT seq, 'gap' AS problem FROM st WHERE seq <> last + 1 UNION ALL SELECT seq, 'chain' FROM st WHERE prev_hash <> before UNION ALL SELECT seq, 'hash' FROM st WHERE hash <> sha256(seq || '|' || name || '|' || outcome || '|' || prev_hash) UNION ALL SELECT seq, 'name' FROM st WHERE trim(name) = ''")
def a04(spark, sf):
    k = F.col("c_custkey")
    own = lambda n: F.sha2(F.concat(F.lit("h"), n.cast("string")), 256)
    rows = table(spark, sf, "customer").where("c_custkey % 70 != 0")
    lines = rows.select((k - 1).alias("seq"), F.when(k % 50 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.lit("ok").alias("outcome"), F.when(k == 1, "").otherwise(own(k - 2)).alias("prev_hash"), own(k - 1).alias("hash"))
    return evaluate.verify_ledger(lines)


@query("a07_soundness", "SELECT doc_id, CAST(CASE WHEN quality = 1 THEN 1 ELSE -1 END AS INT) AS a_sign, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 WHEN toxic = 1 THEN -1 ELSE 1 END AS INT) AS b_sign, (CASE WHEN quality = 1 THEN 1 ELSE -1 END + CASE WHEN doc_id % 3 = 0 THEN 0 WHEN toxic = 1 THEN -1 ELSE 1 END) / 2.0::DOUBLE AS score FROM labels")
def a07(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", (F.col("quality") != 1).alias("a"), F.when(F.col("doc_id") % 3 != 0, F.col("toxic") == 1).alias("b"))
    return studies.soundness(rows, ["a", "b"]).select("doc_id", "a_sign", "b_sign", "score")


@query("a11_redundancy_power", "SELECT p_size AS pairs, round((1 - 0.02::DOUBLE) ** p_size, 9) AS power FROM (SELECT DISTINCT p_size FROM part)")
def a11(spark, sf):
    return table(spark, sf, "part").select("p_size").distinct().select(F.col("p_size").alias("pairs"), r(F.pow(F.lit(1 - 0.02), "p_size"), 9).alias("power"))


@query("a13_survivors", "SELECT c_custkey AS name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority < '2') AS survived FROM customer")
def a13(spark, sf):
    o = table(spark, sf, "orders")
    rejected = o.select(F.col("o_custkey").alias("name"), F.substring("o_orderpriority", 1, 1).alias("layer"))
    return studies.survivors(table(spark, sf, "customer").select(F.col("c_custkey").alias("name")), o.select(F.col("o_custkey").alias("name")), rejected, ["1"])


@query("a14_cross_arm_duplicates", "SELECT count(*) AS clusters, count(*) FILTER (WHERE arms > 1) AS across, round(count(*) FILTER (WHERE arms > 1) / count(*), 6) AS share FROM (SELECT p_size, p_type, count(*) AS members, count(DISTINCT p_brand) AS arms FROM part GROUP BY 1, 2) WHERE members > 1")
def a14(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("arm"), F.struct("p_size", "p_type").alias("cluster"))
    return studies.cross_arm_share(rows).withColumn("share", r("share"))


@query("a15_nearest_series", sql("SELECT name, nearest, round(c, 6) AS correlation FROM (SELECT a.symbol AS name, b.symbol AS nearest, corr(a.ret, b.ret) AS c, row_number() OVER (PARTITION BY a.symbol ORDER BY corr(a.ret, b.ret) DESC, b.symbol) AS k FROM ret a JOIN ret b ON a.session_date = b.session_date AND a.symbol <> b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 21) WHERE k = 1", RET))
def a15(spark, sf):
    pairs = evaluate.correlations(series(spark, sf).select("session_date", F.col("strategy").alias("name"), "ret"))
    return studies.nearest(pairs).withColumn("correlation", r("correlation"))


@query("a16_pooled_corpora", "SELECT c_custkey AS name, 0 AS corpus FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 2 = 1")
def a16(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.lit("v1").alias("version"))
    return studies.pool([rows.where("name % 2 = 0"), rows.where("name % 2 = 1")], ["version"]).select("name", "corpus")


FACTOR_RETURNS = f"""{RET}, sc AS (SELECT symbol, session_date, factor, score FROM (SELECT symbol, session_date, -(close / lag(close, 4) OVER w - 1) AS reversal_1m, CASE WHEN count(turnover_inr) OVER b = 8 THEN -ln(1 + avg(turnover_inr) OVER b) END AS liquidity_size_proxy FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY session_date), b AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) UNPIVOT (score FOR factor IN (reversal_1m, liquidity_size_proxy))),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_date, factor ORDER BY score, symbol) AS k, count(*) OVER (PARTITION BY session_date, factor) AS n FROM sc WHERE score IS NOT NULL),
sd AS (SELECT *, CASE WHEN k > n - ceil(n * 0.2) THEN 1.0 WHEN k <= ceil(n * 0.2) THEN -1.0 END AS side FROM rk WHERE n >= 10),
bo AS (SELECT session_date, factor, symbol, side / count(*) OVER (PARTITION BY session_date, factor, side) AS weight FROM sd WHERE side IS NOT NULL),
fw AS (SELECT symbol, session_date, lead(close, 2) OVER w / lead(close, 1) OVER w - 1 AS f FROM wk WINDOW w AS (PARTITION BY symbol ORDER BY session_date)),
fr AS (SELECT factor, session_date, sum(weight * f) AS ret FROM bo JOIN fw USING (session_date, symbol) WHERE f IS NOT NULL GROUP BY 1, 2)"""


def factor_returns(spark, sf):
    from pitwright.operators import labels

    panel = week(spark, sf)
    scores = features.factor_scores(panel, month=4, half_year=8, year=12).where("factor in ('reversal_1m', 'liquidity_size_proxy')")
    forward = labels.forward_returns(panel, (1,)).select("session_date", "symbol", "fwd_1").where("fwd_1 is not null")
    return features.long_short(scores, quantile=0.2).join(forward, ["session_date", "symbol"]).groupBy("factor", "session_date").agg(F.sum(F.col("weight") * F.col("fwd_1")).alias("ret"))


@query("a17_standard_factors", sql("SELECT factor, count(*) AS n, round(avg(ret) / stddev_samp(ret), 6) AS sharpe FROM fr GROUP BY 1", FACTOR_RETURNS))
def a17(spark, sf):
    out = studies.statistical_layer(factor_returns(spark, sf), "factor")
    return out.select("factor", "n", r("sharpe").alias("sharpe"))


@query("a18_flow_conditional", sql("SELECT round(median(capacity) FILTER (WHERE month(session_date) < 7) / median(capacity) FILTER (WHERE month(session_date) >= 7), 6) AS ratio FROM percap", CAPACITY))
def a18(spark, sf):
    per = domain.per_session(spark, sf)
    states = per.select("session_date", F.when(F.month("session_date") < 7, "outflow").otherwise("inflow").alias("flow_state")).distinct()
    return capacity.flow_ratio(capacity.capacity_by_state(per, states)).select(r("ratio").alias("ratio"))


# Capacity


@query("q10_capacity_by_flow_state", sql("SELECT s, round(median(capacity), 6) AS median_capacity, count(*) AS n_sessions FROM (SELECT *, CASE WHEN month(session_date) < 7 THEN 'outflow' ELSE 'inflow' END AS s FROM percap) GROUP BY 1", CAPACITY))
def q10(spark, sf):
    per = domain.per_session(spark, sf)
    states = per.select("session_date", F.when(F.month("session_date") < 7, "outflow").otherwise("inflow").alias("flow_state")).distinct()
    return capacity.capacity_by_state(per, states).select(F.col("flow_state").alias("s"), r("median_capacity").alias("median_capacity"), "n_sessions")


@query("q11_net_positions", "SELECT CAST(ts AS DATE) AS session_date, sum(CASE WHEN user_id % 2 = 0 THEN event_id END)::BIGINT - sum(CASE WHEN user_id % 2 = 1 THEN event_id END)::BIGINT AS net FROM events WHERE event_type = 'purchase' GROUP BY 1")
def q11(spark, sf):
    rows = table(spark, sf, "events").select(F.to_date("ts").alias("session_date"), F.col("event_type").alias("category"), F.when(F.col("user_id") % 2 == 0, "Total Long Contracts").otherwise("Total Short Contracts").alias("measure"), F.col("event_id").alias("contracts"))
    return capacity.net_positions(rows, "purchase")


@query("q13_participation_and_impact", sql("SELECT symbol, session_date, round(1e5 / adv_inr, 6) AS share, round(0.5 * 0.02 * sqrt(1e5 / adv_inr), 6) AS impact FROM meas WHERE adv_inr > 0", MEASURES))
def q13(spark, sf):
    m = features.daily_measures(week(spark, sf), window=8).where("adv_inr > 0")
    share = capacity.participation(F.lit(1e5), F.col("adv_inr"))
    return m.select("symbol", "session_date", r(share).alias("share"), r(capacity.square_root_impact(share, F.lit(0.02), 0.5)).alias("impact"))


HALVES = f"{MEASURES}, hv AS (SELECT m.*, CASE WHEN session_idx < (SELECT (max(session_idx) + 1) // 2 FROM cal) THEN 'first' ELSE 'second' END AS half FROM meas m JOIN cal USING (session_date)), ex AS (SELECT symbol, half, regr_slope(ln(abs_ret), ln(turnover_inr / adv_inr)) AS d FROM hv WHERE abs_ret > 0 AND adv_inr > 0 AND turnover_inr > 0 GROUP BY 1, 2), am AS (SELECT symbol, half, avg(amihud) * 1e6 AS a FROM hv GROUP BY 1, 2)"


@query("q15_split_half", sql("SELECT e.symbol, round(e.d, 6) AS exponent_first, round(f.d, 6) AS exponent_second, round(a.a, 6) AS amihud_first, round(b.a, 6) AS amihud_second FROM ex e JOIN ex f ON f.symbol = e.symbol AND f.half = 'second' JOIN am a ON a.symbol = e.symbol AND a.half = 'first' JOIN am b ON b.symbol = e.symbol AND b.half = 'second' WHERE e.half = 'first' AND e.d IS NOT NULL AND f.d IS NOT NULL AND a.a IS NOT NULL AND b.a IS NOT NULL", HALVES))
def q15(spark, sf):
    panel = week(spark, sf)
    m, cal = features.daily_measures(panel, window=8), calendar.build(panel)
    exponent = lambda df, by: df.where("abs_ret > 0 and rel_value > 0").groupBy(*by).agg(F.regr_slope(F.ln("abs_ret"), F.ln("rel_value")).alias("value"))
    amihud = lambda df, by: df.groupBy(*by).agg((F.avg("amihud_term") * 1e6).alias("value"))
    halves = lambda fit, n: studies.split_half(m, cal, fit).select("symbol", r("first").alias(f"{n}_first"), r("second").alias(f"{n}_second"))
    return halves(exponent, "exponent").join(halves(amihud, "amihud"), "symbol")


@query("q16_exposure_strata", sql("SELECT symbol AS strategy, round(median(x), 6) AS median_gross, CASE WHEN median(x) < 0.1 THEN 'near_cash' ELSE 'invested' END AS stratum FROM (SELECT symbol, (day(session_date) % 10) / 50.0::DOUBLE * length(symbol) / 8.0::DOUBLE AS x FROM wk) GROUP BY 1"))
def q16(spark, sf):
    rows = week(spark, sf).select(F.col("symbol").alias("strategy"), ((F.dayofmonth("session_date") % 10) / 50.0 * F.length("symbol") / 8.0).alias("gross_exposure"))
    return studies.exposure_strata(rows).withColumn("median_gross", r("median_gross"))


# Stress

LABELS = "lb AS (SELECT rf AS refit_date, session_date, (session_idx * (3 + month(rf)) // 5) % 2 AS state FROM cal, (VALUES (DATE '1994-03-01'), (DATE '1995-06-01'), (DATE '1996-09-01')) t(rf) WHERE session_date >= rf)"


def refit_labels(spark, sf):
    cal = calendar.build(week(spark, sf))
    days = F.explode(F.array(*[F.lit(d).cast("date") for d in ("1994-03-01", "1995-06-01", "1996-09-01")])).alias("refit_date")
    return cal.select("session_date", "session_idx", days).where("session_date >= refit_date").withColumn("state", F.expr("cast(session_idx * (3 + month(refit_date)) div 5 as int) % 2"))


@query("r06_stability", sql("SELECT refit_date, n, changed, round(changed / n, 6) AS rate, round(terminal, 6) AS terminal FROM (SELECT refit_date, count(before) AS n, count(*) FILTER (WHERE before <> state) AS changed, avg((state <> final)::INT) AS terminal FROM (SELECT *, lag(state) OVER (PARTITION BY session_date ORDER BY refit_date) AS before, max_by(state, refit_date) OVER (PARTITION BY session_date) AS final FROM lb) GROUP BY 1) WHERE n > 0", LABELS))
def r06(spark, sf):
    labels = refit_labels(spark, sf)
    last = stress.terminal_disagreement(labels).select("refit_date", r("rate").alias("terminal"))
    return stress.revisions(labels).withColumn("rate", r("rate")).join(last, "refit_date")


SERIES = "se AS (SELECT row_number() OVER (ORDER BY session_date) - 1 AS session_idx, ret FROM (SELECT session_date, c / lag(c) OVER (ORDER BY session_date) - 1 AS ret FROM (SELECT session_date, avg(close) AS c FROM wk GROUP BY 1)) WHERE ret IS NOT NULL)"


def index_series(spark, sf):
    order = W.orderBy("session_date")
    rows = domain.index(spark, sf).withColumn("ret", F.try_divide("close", F.lag("close").over(order)) - 1).where("ret is not null")
    return rows.withColumn("session_idx", (F.row_number().over(order) - 1).cast("int")).select("session_idx", "ret")


@query("r08_bootstrap_paths", sql("SELECT path_id, count(*) AS steps, count(*) FILTER (WHERE jump) AS jumps, sum(src_idx * (step + 1))::BIGINT AS checksum FROM paths JOIN steps USING (path_id, step) GROUP BY 1", f"{SERIES}, {drawn('(SELECT count(*) FROM se)', 1000, 8.0, 42)}, {paths_sql()}"))
def r08(spark, sf):
    n = index_series(spark, sf).count()
    paths = stress.bootstrap_paths(spark, n, 1000, 8.0, 42)
    before = F.lag("src_idx").over(W.partitionBy("path_id").orderBy("step"))
    from pitwright.operators.frames import uniform

    jump = (F.col("step") == 0) | (uniform(42, F.col("path_id"), F.col("step"), "jump") < 1 / 8.0)
    return paths.groupBy("path_id").agg(F.count("*").alias("steps"), F.count_if(jump).alias("jumps"), F.sum(F.col("src_idx").cast("bigint") * (F.col("step") + 1)).alias("checksum"))


BATTERY = f"""{SERIES}, {drawn('(SELECT count(*) FROM se)', 1000, 8.0, 42)}, {paths_sql()},
dr AS (SELECT path_id, step, ret FROM paths JOIN se ON session_idx = src_idx),
lg AS (SELECT *, lag(ret) OVER w AS b1, lag(ret, 5) OVER w AS b5, lag(ret, 21) OVER w AS b21, product(1 + ret) OVER w AS e FROM dr WINDOW w AS (PARTITION BY path_id ORDER BY step)),
fa AS (SELECT *, 1 - e / greatest(1.0::DOUBLE, max(e) OVER (PARTITION BY path_id ORDER BY step)) AS fall FROM lg)"""
MOMENT_COLUMNS = "avg(ret) AS mean, stddev_samp(ret) AS sd, (avg(ret ** 3) - 3 * avg(ret) * avg(ret ** 2) + 2 * avg(ret) ** 3) / stddev_pop(ret) ** 3 AS skew, corr(ret, b1) AS autocorrelation, corr(abs(ret), abs(b1)) AS size_autocorrelation, corr(abs(ret), abs(b5)) AS size_autocorrelation_5, corr(abs(ret), abs(b21)) AS size_autocorrelation_21, quantile_cont(ret, 0.05) AS p05, max(fall) AS max_drawdown"
ROUNDED = ("mean", "sd", "skew", "autocorrelation", "size_autocorrelation", "size_autocorrelation_5", "size_autocorrelation_21", "p05", "max_drawdown")


@query("r09_moment_battery", sql("SELECT path_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ROUNDED) + f" FROM (SELECT path_id, {MOMENT_COLUMNS} FROM fa GROUP BY 1)", BATTERY))
def r09(spark, sf):
    series_ = index_series(spark, sf)
    out = stress.battery(stress.gather(stress.bootstrap_paths(spark, series_.count(), 1000, 8.0, 42), series_), ["path_id"])
    return out.select("path_id", *[r(c).alias(c) for c in ROUNDED])


@query(
    "r09_battery_against_real",
    sql(
        "SELECT statistic, round(v, 6) AS real, round(quantile_cont(value, 0.05), 6) AS low, round(quantile_cont(value, 0.95), 6) AS high, round(avg((value <= v + 1e-12)::INT), 6) AS percentile FROM (SELECT * FROM ba UNPIVOT (value FOR statistic IN (sd, autocorrelation, max_drawdown))) JOIN (SELECT * FROM re UNPIVOT (v FOR statistic IN (sd, autocorrelation, max_drawdown))) USING (statistic) GROUP BY statistic, v",
        f"{BATTERY}, ba AS (SELECT path_id, {MOMENT_COLUMNS} FROM fa GROUP BY 1), rl AS (SELECT *, lag(ret) OVER (ORDER BY session_idx) AS b1, product(1 + ret) OVER (ORDER BY session_idx) AS e FROM se), re AS (SELECT stddev_samp(ret) AS sd, corr(ret, b1) AS autocorrelation, max(1 - e / greatest(1.0::DOUBLE, m)) AS max_drawdown FROM (SELECT *, max(e) OVER (ORDER BY session_idx) AS m FROM rl))",
    ),
)
def r09_real(spark, sf):
    series_ = index_series(spark, sf)
    drawn_ = stress.battery(stress.gather(stress.bootstrap_paths(spark, series_.count(), 1000, 8.0, 42), series_), ["path_id"])
    own = stress.battery(series_.withColumn("path_id", F.lit(0)), ["path_id"], "session_idx")
    out = stress.compare_battery(drawn_, own).where("statistic in ('sd', 'autocorrelation', 'max_drawdown')")
    return out.select("statistic", *[r(c).alias(c) for c in ("real", "low", "high", "percentile")])


def synthetic_sql(paths: int) -> str:
    return f"""mvd AS (SELECT session_idx, symbol, open, high, low, close, turnover_inr, ln(close / lag(close) {OVER}) AS lr, first_value(close) {OVER} AS anchor FROM wk JOIN cal USING (session_date)),
{drawn('(SELECT count(*) FROM cal)', paths, 8.0, 42)}, {paths_sql()},
lv AS (SELECT path_id, step, symbol, open, high, low, close, turnover_inr, lr IS NULL AS carried, anchor * exp(sum(coalesce(lr, 0)) OVER (PARTITION BY path_id, symbol ORDER BY step)) AS level FROM paths JOIN mvd ON session_idx = src_idx),
sy AS (SELECT path_id, step, symbol, open * level / close AS open, high * level / close AS high, low * level / close AS low, level AS close, turnover_inr, carried FROM lv)"""


@query("r10_synthetic_panel", sql("SELECT path_id, symbol, count(*) AS steps, round(sum(ln(open)), 4) AS open, round(sum(ln(high)), 4) AS high, round(sum(ln(low)), 4) AS low, round(sum(ln(close)), 4) AS close, round(sum(turnover_inr), 2) AS turnover, count(*) FILTER (WHERE carried) AS carried FROM sy GROUP BY 1, 2", synthetic_sql(100)))
def r10(spark, sf):
    panel = week(spark, sf)
    cal = calendar.build(panel)
    out = stress.synthetic_panel(stress.bootstrap_paths(spark, cal.count(), 100, 8.0, 42), panel, cal)
    return out.groupBy("path_id", "symbol").agg(F.count("*").alias("steps"), *[r(F.sum(F.ln(c)), 4).alias(c) for c in ("open", "high", "low", "close")], r(F.sum("turnover_inr"), 2).alias("turnover"), F.count_if("carried").alias("carried"))


@query("r11_panel_diagnostics", sql("SELECT path_id, expected, expected - found AS missing, carried, round(ln(1 + max_move), 4) AS log_move FROM (SELECT path_id, count(*) FILTER (WHERE carried) AS carried, max(abs(close / before - 1)) AS max_move, count(m.symbol) AS found FROM (SELECT *, lag(close) OVER (PARTITION BY path_id, symbol ORDER BY step) AS before FROM sy) s LEFT JOIN mm m ON m.symbol = s.symbol AND m.step = s.step GROUP BY 1), (SELECT count(*) AS expected FROM mm)", f"{synthetic_sql(20)}, {MEMBERS}, mm AS (SELECT session_idx AS step, symbol FROM mem JOIN cal USING (session_date))"))
def r11(spark, sf):
    panel = week(spark, sf)
    cal = calendar.build(panel)
    own = members(spark, sf).join(cal, "session_date").select(F.col("session_idx").alias("step"), "symbol")
    out = stress.panel_diagnostics(stress.synthetic_panel(stress.bootstrap_paths(spark, cal.count(), 20, 8.0, 42), panel, cal), own)
    return out.select("path_id", "expected", "missing", "carried", r(F.log1p("max_move"), 4).alias("log_move"))


STRATEGIES = f"{RET}, sr AS (SELECT symbol AS strategy, row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS session_idx, ret FROM ret WHERE ret IS NOT NULL), short AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM sr GROUP BY strategy))"


def strategy_series(spark, sf):
    rows = series(spark, sf)
    numbered = rows.withColumn("session_idx", (F.row_number().over(W.partitionBy("strategy").orderBy("session_date")) - 1).cast("int")).select("strategy", "session_idx", "ret")
    return numbered, numbered.groupBy("strategy").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]


TIER2 = f"{STRATEGIES}, {drawn('(SELECT n FROM short)', 50, 8.0, 11)}, {paths_sql()}, gt AS (SELECT strategy, path_id, ret, session_idx % 3 AS state FROM paths JOIN sr ON session_idx = src_idx)"


@query("r13_fragility_across_paths", sql("SELECT strategy, count(*) AS paths, round(var_samp(s) / abs(avg(s)), 4) AS fragility FROM (SELECT strategy, path_id, avg(ret) / stddev_samp(ret) * sqrt(252) AS s FROM gt GROUP BY 1, 2) GROUP BY 1", TIER2))
def r13(spark, sf):
    rows, n = strategy_series(spark, sf)
    out = stress.fragility_across_paths(stress.gather(stress.bootstrap_paths(spark, n, 50, 8.0, 11), rows), ["strategy"])
    return out.select("strategy", "paths", r("fragility", 4).alias("fragility"))


@query("r14_resampled_fragility", sql("SELECT strategy, round(avg(f), 3) AS mean_fragility, count(f) AS paths FROM (SELECT strategy, path_id, var_samp(s) / abs(avg(s)) AS f FROM (SELECT strategy, path_id, state, avg(ret) / stddev_samp(ret) * sqrt(252) AS s FROM gt GROUP BY 1, 2, 3 HAVING count(*) >= 21 AND stddev_samp(ret) > 1e-12) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1", TIER2))
def r14(spark, sf):
    rows, n = strategy_series(spark, sf)
    states = spark.range(n).select(F.col("id").cast("int").alias("session_idx"), (F.col("id") % 3).alias("state"))
    _, inside = stress.resampled_fragility(stress.bootstrap_paths(spark, n, 50, 8.0, 11), rows, states, ["strategy"])
    return inside.select("strategy", r("mean_fragility", 3).alias("mean_fragility"), "paths")


@query("r15_rerun_on_paths", sql("SELECT p AS path_id, session_date, round(g, 4) AS gross_return, round(t, 6) AS turnover FROM gross, range(3) a(p)", GROSS))
def r15(spark, sf):
    """Strategies decided anew on each path's panel. The paths here lead through all sessions in order, so each run must
    give what the real panel gives."""
    panel = week(spark, sf)
    cal = calendar.build(panel)
    paths = cal.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("path_id"), F.col("session_idx").alias("step"), F.col("session_idx").alias("src_idx"))
    out = stress.rerun(stress.synthetic_panel(paths, panel, cal), cal, momentum_scores, scale=0.5)
    return out.select("path_id", "session_date", r("gross_return", 4).alias("gross_return"), r("turnover").alias("turnover"))


@query("r16_rank_agreement", sql("SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY m, symbol) AS a, row_number() OVER (ORDER BY sd, symbol) AS b FROM mo)", MOMENTS))
def r16(spark, sf):
    rows = statistics.moments(series(spark, sf), ["strategy"], "ret")
    return evaluate.spearman(rows, "mean", "sd", "strategy").withColumn("spearman", r("spearman"))


@query("r17_concentration_and_holding", sql("SELECT round(h, 6) AS herfindahl, round(n, 6) AS names, round(held / entries, 6) AS holding_period FROM (SELECT avg(h) AS h, avg(n) AS n FROM (SELECT session_date, sum((abs(weight) / g) ** 2) AS h, count(*) AS n FROM (SELECT *, sum(abs(weight)) OVER (PARTITION BY session_date) AS g FROM tgt) GROUP BY 1)), (SELECT count(*) FILTER (WHERE held) AS held, count(*) FILTER (WHERE held AND p = 0) AS entries FROM mv)", GROSS))
def r17(spark, sf):
    weights = momentum_run(spark, sf)[0]
    out = studies.concentration(weights).join(studies.holding_period(weights), "strategy")
    return out.select(r("herfindahl").alias("herfindahl"), r("names").alias("names"), r("holding_period").alias("holding_period"))


@query("r17_book_similarity", sql("SELECT lag, round(avg(coalesce(dot, 0) / (a.nm * b.nm)), 6) AS similarity, count(*) AS n FROM (VALUES (5), (21), (63)) l(lag), nm a JOIN nm b ON b.i = a.i + lag LEFT JOIN dots d ON d.i = a.i AND d.j = b.i GROUP BY 1", f"{GROSS}, ti AS (SELECT *, dense_rank() OVER (ORDER BY session_date) AS i FROM tgt), nm AS (SELECT i, sqrt(sum(weight ** 2)) AS nm FROM ti GROUP BY 1), dots AS (SELECT a.i, b.i AS j, sum(a.weight * b.weight) AS dot FROM ti a JOIN ti b ON a.symbol = b.symbol AND b.i - a.i IN (5, 21, 63) GROUP BY 1, 2)"))
def r17_similarity(spark, sf):
    return studies.book_similarity(momentum_run(spark, sf)[0]).select("lag", r("similarity").alias("similarity"), "n")


BETAS = f"{STRATEGIES.split(', sr AS')[0]}, {BASKETS}, xb AS (SELECT symbol AS strategy, ret, e, t FROM ret JOIN bk USING (session_date) WHERE ret IS NOT NULL)"


@query("r18_univariate_betas", sql("SELECT strategy, round(covar_samp(ret, e) / var_samp(e), 5) AS beta_equal_weight, round(covar_samp(ret, t) / var_samp(t), 5) AS beta_by_turnover FROM xb GROUP BY 1", BETAS))
def r18(spark, sf):
    out = studies.univariate_betas(series(spark, sf), studies.baskets(week(spark, sf)), ["equal_weight", "by_turnover"])
    return out.select("strategy", r("beta_equal_weight", 5).alias("beta_equal_weight"), r("beta_by_turnover", 5).alias("beta_by_turnover"))


@query("r18_joint_betas", sql("SELECT strategy, round((ce * vt - ct * cet) / (ve * vt - cet ** 2), 4) AS beta_equal_weight, round((ct * ve - ce * cet) / (ve * vt - cet ** 2), 4) AS beta_by_turnover FROM (SELECT strategy, covar_pop(ret, e) AS ce, covar_pop(ret, t) AS ct, var_pop(e) AS ve, var_pop(t) AS vt, covar_pop(e, t) AS cet FROM xb GROUP BY 1)", BETAS))
def r18_joint(spark, sf):
    out = studies.joint_betas(series(spark, sf), studies.baskets(week(spark, sf)), ["equal_weight", "by_turnover"])
    return out.select("strategy", r("beta_equal_weight", 4).alias("beta_equal_weight"), r("beta_by_turnover", 4).alias("beta_by_turnover"))


@query("r21_replicates_agree", sql("SELECT count(*) AS compared, 0::BIGINT AS unmatched, true AS equal FROM gross", GROSS))
def r21(spark, sf):
    once, again = (backtest.gross(*momentum_run(spark, sf)) for _ in range(2))
    out = studies.disagreements(once, again, ["session_date"], "gross_return")
    return out.select("compared", "unmatched", (F.col("largest") <= 1e-9).alias("equal"))


@query("x04_conformance", "SELECT name, ok, class FROM (VALUES ('one', true, 'A'), ('none', false, NULL), ('two', false, NULL), ('broken', false, NULL)) t(name, ok, class)")
def x04(spark, sf):
    from pitwright.operators.audit import conformance

    one = "class {}:\n    def generate(self, view):\n        return view\n"
    rows = [("one", one.format("A")), ("none", "x = 1\n"), ("two", one.format("A") + one.format("B")), ("broken", "def (")]
    return conformance(spark.createDataFrame(rows, "name string, source string")).select("name", "ok", "class")


@query("x06_token_accounting", "SELECT o_orderstatus AS arm, sum(o_custkey)::BIGINT AS tokens, count(*) FILTER (WHERE o_totalprice > 100000) AS accepted, round(sum(o_custkey) / nullif(count(*) FILTER (WHERE o_totalprice > 100000), 0), 6) AS tokens_per_accepted FROM orders GROUP BY 1")
def x06(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("arm"), F.col("o_custkey").alias("tokens"), (F.col("o_totalprice") > 100000).alias("accepted"))
    return studies.token_accounting(rows).withColumn("tokens_per_accepted", r("tokens_per_accepted"))


#: Sources with a leak of each kind, and honest ones that look like it.
SAMPLES = {
    "shift": ("def f(view):\n    return view.closes(5).shift(-1)\n", [("future_indexing", 2)]),
    "slice": ("def f(series, t):\n    return series[t + 1:]\n", [("future_indexing", 2)]),
    "held": ("class S:\n    def __init__(self, rows):\n        self.rows = rows\n    def generate(self, view):\n        return self.rows.filter(1)\n", [("point_in_time_bypass", 5)]),
    "level": ("class S:\n    def __init__(self, rows):\n        self.cut = rows['x'].quantile(0.8)\n    def generate(self, view):\n        return []\n", [("full_sample_statistic", 3)]),
    "centred": ("def f(view):\n    return view.closes().rolling_mean(window_size=21, center=True)\n", [("boundary_crossing_window", 2)]),
    "lag": ("def f(view):\n    return view.closes(5).shift(1)\n", []),
    "window": ("class S:\n    def __init__(self, n=5):\n        self.n = n\n    def generate(self, view):\n        return view.closes(self.n)['x'].mean()\n", []),
}


@query("x01_static_audit", "SELECT name, leak_class, line FROM (VALUES " + ", ".join(f"('{n}', '{c}', {at})" for n, (_, found) in SAMPLES.items() for c, at in found) + ") t(name, leak_class, line)")
def x01(spark, sf):
    from pitwright.operators.audit import findings

    rows = spark.createDataFrame([(n, s) for n, (s, _) in SAMPLES.items()], "name string, source string")
    return findings(rows).select("name", F.explode("findings").alias("f")).select("name", "f.leak_class", "f.line")


# Predictors and what they rest on

PREDICT = f"{MEASURES}, pr AS (SELECT row_number() OVER (ORDER BY symbol, session_date) AS k, abs_ret AS y, turnover_inr / adv_inr AS x FROM meas WHERE abs_ret IS NOT NULL AND adv_inr > 0 AND abs_ret < 50), pf AS (SELECT *, k % 5 AS fold FROM pr)"


def predict_rows(spark, sf):
    m = features.daily_measures(week(spark, sf), window=8).where("abs_ret is not null and adv_inr > 0 and abs_ret < 50")
    from pitwright.operators.frames import global_rank

    rows = global_rank(m.select("symbol", "session_date", F.col("abs_ret").alias("y"), F.col("rel_value").alias("x")), F.asc("symbol"), F.asc("session_date"))
    return rows.select(F.col("rank").alias("k"), "x", "y", (F.col("rank") % 5).alias("fold"))


@query("r07_autocovariances", sql("SELECT lag, round(sum(a.x * b.x) / (SELECT count(*) FROM se), 6) AS covariance FROM (SELECT session_idx, ret - (SELECT avg(ret) FROM se) AS x FROM se) a JOIN (SELECT session_idx, ret - (SELECT avg(ret) FROM se) AS x FROM se) b ON b.session_idx >= a.session_idx AND b.session_idx <= a.session_idx + 20, LATERAL (SELECT b.session_idx - a.session_idx AS lag) GROUP BY 1", SERIES))
def r07(spark, sf):
    return stress.autocovariances(index_series(spark, sf), 20).select("lag", r("covariance").alias("covariance"))


@query("r19_out_of_fold", sql("SELECT k, round(regr_intercept(o.y, o.x) + regr_slope(o.y, o.x) * any_value(t.x), 5) AS predicted, round(avg(o.y), 6) AS mean_of_others FROM pf t JOIN (SELECT a.f AS fold, y, x FROM pf, (SELECT unnest(range(5)) AS f) a WHERE pf.fold <> a.f) o USING (fold) GROUP BY k", PREDICT).replace("FROM pf t JOIN", "FROM pf t JOIN"))
def r19(spark, sf):
    from pitwright.operators import predict

    out = predict.out_of_fold(predict_rows(spark, sf), ["x"], "y", kind="linear")
    return out.select("k", r("predicted", 5).alias("predicted"), r("mean_of_others").alias("mean_of_others"))


@query("r20_leave_one_out", sql("SELECT k, round((sxy - n / (n - 1) * (x - mx) * (y - my)) / (sxx - n / (n - 1) * (x - mx) ** 2), 6) AS slope FROM pr, (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM pr)", PREDICT))
def r20(spark, sf):
    from pitwright.operators import predict

    return predict.leave_one_out(predict_rows(spark, sf), "k", "x", "y").select("k", r("slope").alias("slope"))


@query("r20_learning_curve", sql("SELECT size, round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r_squared FROM pr JOIN (SELECT unnest([100, 400, 1600]) AS size) ON k <= size GROUP BY 1", PREDICT))
def r20_curve(spark, sf):
    from pitwright.operators import predict

    return predict.learning_curve(predict_rows(spark, sf), "k", "x", "y", [100, 400, 1600]).select("size", r("slope").alias("slope"), r("r_squared").alias("r_squared"))


@query("r20_trimmed", sql("SELECT round(avg(y), 6) AS mean, count(*) AS n FROM pr WHERE y BETWEEN (SELECT quantile_cont(y, 0.1) FROM pr) AND (SELECT quantile_cont(y, 0.9) FROM pr)", PREDICT))
def r20_trimmed(spark, sf):
    from pitwright.operators import predict

    return predict.trimmed(predict_rows(spark, sf), "y", 0.1).select(r("mean").alias("mean"), "n")


UNIFORM_OF = "(('0x' || substr(sha256('4|' || symbol), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


@query("a09_matched_subsample", recursive(sql(f"SELECT symbol AS strategy, round({normal.cdf_sql('z1')}, 7) AS dsr FROM zs", deflated("count(*)").replace("WHERE ret IS NOT NULL GROUP BY 1)", f"WHERE ret IS NOT NULL AND symbol IN (SELECT symbol FROM (SELECT DISTINCT symbol FROM wk) ORDER BY {UNIFORM_OF}, symbol LIMIT 12) GROUP BY 1)", 1))))
def a09(spark, sf):
    from pitwright.operators.frames import subsample

    rows = series(spark, sf)
    chosen = subsample(rows.select("strategy").distinct().withColumn("arm", F.lit(1)), ["arm"], "strategy", 12, 4)
    return studies.statistical_layer(rows.join(chosen.select("strategy"), "strategy", "left_semi")).select("strategy", r("dsr", 7).alias("dsr"))


@query("a12_best_of_matched", "SELECT o_orderkey // 7 AS block, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS idx, round(max(o_totalprice), 4) AS score FROM orders GROUP BY 1")
def a12(spark, sf):
    k = studies.matched_draws(budget=3_500, cost=480)
    trials = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("score"))
    return evaluate.best_of_blocks(trials, k).withColumn("score", r("score", 4))


@query("a19_meta_funnel", "SELECT corpus, count(*) AS n, count(*) FILTER (WHERE a) AS traded, round(avg(a::INT), 6) AS traded_rate, count(*) FILTER (WHERE a AND b) AS kept, round(avg((a AND b)::INT), 6) AS kept_rate FROM (SELECT 0 AS corpus, c_acctbal > 0 AS a, c_mktsegment < 'F' AS b FROM customer UNION ALL SELECT 1, s_acctbal > 0, s_nationkey < 12 FROM supplier) GROUP BY 1")
def a19(spark, sf):
    from pitwright.operators.frames import funnel

    c = table(spark, sf, "customer").select((F.col("c_acctbal") > 0).alias("a"), (F.col("c_mktsegment") < "F").alias("b"), F.lit("v1").alias("version"))
    s = table(spark, sf, "supplier").select((F.col("s_acctbal") > 0).alias("a"), (F.col("s_nationkey") < 12).alias("b"), F.lit("v1").alias("version"))
    out = funnel(studies.pool([c, s], ["version"]), ["corpus"], {"traded": F.col("a"), "kept": F.col("b")})
    return out.withColumns({c: r(c) for c in ("traded_rate", "kept_rate")})


@query(
    "r20_permutation_test",
    sql(
        "SELECT round(r2, 6) AS r_squared, round((count(*) FILTER (WHERE own >= r2) + 1) / 41.0::DOUBLE, 6) AS p_value FROM (SELECT regr_r2(y, x) AS r2 FROM pr) JOIN (SELECT a.d, regr_r2(a.y, b.x) AS own FROM pm a JOIN pm b ON a.d = b.d AND a.i = b.j GROUP BY 1) ON true GROUP BY r2",
        f"{PREDICT}, pm AS (SELECT d, k, x, y, row_number() OVER (PARTITION BY d ORDER BY k) AS i, row_number() OVER (PARTITION BY d ORDER BY (('0x' || substr(sha256('6|' || d || '|' || k), 1, 12))::BIGINT / 281474976710656.0::DOUBLE), k) AS j FROM pr, range(40) t(d))",
    ),
)
def r20_permutations(spark, sf):
    from pitwright.operators import predict

    out = predict.permutation_test(predict_rows(spark, sf), "k", "x", "y", draws=40, seed=6)
    return out.select(r("r_squared").alias("r_squared"), r("p_value").alias("p_value"))
