"""Streams with state, and functions and strategies of users' own, as queries."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from pitwright.functions import tables
from pitwright.operators import calendar
from pitwright.operators.protocol import fitness, run_strategy
from pitwright.plans.inventory import drawn, paths_sql
from pitwright.plans.relational import ORACLES, QUERIES, query, r, sql, week
from pitwright.sources.panels import table
from pitwright.streaming import flows, state

__all__ = ["ORACLES", "QUERIES"]


def events(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("st1_windowed_flow", "SELECT date_trunc('day', ts) AS window_start, event_type AS symbol, round(sum(value), 4) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def st1(spark, sf):
    out = state.collected(flows.windowed_flow(events(spark, sf)), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "symbol", r("value", 4).alias("value"), "n")


ORDERED = "o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events {})"


@query("st2_hash_ledger", f"WITH RECURSIVE {ORDERED.format('')}, c AS (SELECT user_id, event_id, i, sha256('|' || event_id) AS hash FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, sha256(c.hash || '|' || o.event_id) FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i + 1) SELECT user_id, event_id, i - 1 AS seq, hash FROM c")
def st2(spark, sf):
    return state.collected(state.hash_chain(events(spark, sf)))


@query(
    "st3_forward_filter",
    f"""WITH RECURSIVE {ORDERED.format('WHERE value IS NOT NULL')}, c AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0.5::DOUBLE AS p FROM (SELECT DISTINCT user_id FROM o)
    UNION ALL SELECT user_id, i, event_id, a * q / (a * q + 1 - a) FROM (SELECT o.user_id, o.i, o.event_id, c.p * 0.9::DOUBLE + (1 - c.p) * (1 - 0.9::DOUBLE) AS a, exp(((o.value - 20) ** 2 - (o.value - 60) ** 2) / (2 * 40.0::DOUBLE * 40)) AS q FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i + 1))
    SELECT user_id, event_id, round(p, 8) AS p FROM c WHERE i > 0""",
)
def st3(spark, sf):
    return state.collected(state.forward_filter(events(spark, sf), (20.0, 60.0), 40.0, 0.9)).withColumn("p", r("p", 8))


@query("st4_stateful_book", "SELECT user_id, event_id, round(exp(sum(ln(1 + held * x)) OVER (PARTITION BY user_id ORDER BY event_id)), 8) AS equity FROM (SELECT user_id, event_id, (event_id % 7 - 3) / 100.0::DOUBLE AS x, coalesce(lag((event_id % 5) / 5.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS held FROM events)")
def st4(spark, sf):
    n = F.col("event_id")
    fills = events(spark, sf).select("user_id", "event_id", ((n % 7 - 3) / 100.0).alias("ret"), ((n % 5) / 5.0).alias("weight"))
    return state.collected(state.book(fills)).select("user_id", "event_id", r("equity", 8).alias("equity"))


@query("st5_late_rows", "SELECT event_id, ts < (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL 10 DAY AS late FROM events WHERE event_id % 2 = 1")
def st5(spark, sf):
    rows = table(spark, sf, "events")
    good, late = state.split_late(rows.where("event_id % 2 = 1"), rows.where("event_id % 2 = 0"), late="10 days")
    return good.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query("ud1_table_function", f"WITH {drawn('150', 40, 8.0, 42)}, {paths_sql()} SELECT path_id, CAST(step AS INT) AS step, CAST(src_idx AS INT) AS src_idx FROM paths")
def ud1(spark, sf):
    tables.register(spark)
    return spark.sql("SELECT id AS path_id, step, src_idx FROM range(40), LATERAL bootstrap_path(id, 150, CAST(8 AS DOUBLE), 42)")


@query("ud2_aggregate_function", sql("SELECT symbol, round(mad(volume), 6) AS deviation FROM wk GROUP BY 1"))
def ud2(spark, sf):
    return week(spark, sf).groupBy("symbol").agg(r(tables.median_deviation("volume")).alias("deviation"))


class Reversal:
    """The three names that fell most over the sessions that it sees."""

    def generate(self, view):
        ends = view.groupby("symbol")["close"].agg(["first", "last", "size"])
        moves = (ends["last"] / ends["first"])[ends["size"] == 5].sort_index().sort_values(kind="stable")
        return dict.fromkeys(moves.index[:3], 1 / 3)


@query("ud3_user_strategy", sql("SELECT fill AS session_date, symbol, round(1 / 3.0, 9)::DOUBLE AS weight FROM (SELECT d.session_idx, symbol, row_number() OVER (PARTITION BY d.session_idx ORDER BY max_by(close, session_date) / min_by(close, session_date), symbol) AS k FROM wk JOIN cal USING (session_date) JOIN cal d ON cal.session_idx BETWEEN d.session_idx - 4 AND d.session_idx GROUP BY 1, 2 HAVING count(*) = 5) JOIN (SELECT session_idx, lead(session_date) OVER (ORDER BY session_idx) AS fill FROM cal) USING (session_idx) WHERE k <= 3 AND fill IS NOT NULL"))
def ud3(spark, sf):
    panel = week(spark, sf).select("session_date", "symbol", "close")
    return run_strategy(panel, calendar.build(panel), Reversal(), lookback=5).select("session_date", "symbol", r("weight", 9).alias("weight"))


def _length(source: str) -> float | None:
    if source == "slow":
        time.sleep(600)
    if source == "wrong":
        raise ValueError(source)
    return float(len(source)) if source != "none" else None


@query("ud4_fitness_with_kill", "SELECT source, fitness::DOUBLE AS fitness FROM (VALUES ('abc', 3), ('slow', NULL), ('wrong', NULL), ('none', NULL), ('longer', 6)) t(source, fitness)")
def ud4(spark, sf):
    return fitness(spark.createDataFrame([(s,) for s in ("abc", "slow", "wrong", "none", "longer")], "source string"), _length, seconds=3.0)
