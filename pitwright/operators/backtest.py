"""Backtests as joins: all strategies at once, and one fold over sessions for what depends on equity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.functions.checks import require_columns
from pitwright.operators import costs as C


def validate_signals(signals: DataFrame) -> DataFrame:
    """signals (information_at, decision_session, session_date), failing where information is later than the decision
    or not earlier than the fill."""
    late = (F.col("information_at") >= F.col("session_date")) | (F.col("information_at") > F.col("decision_session"))
    guard = F.when(late, F.raise_error(F.concat(F.lit("information of "), F.col("information_at").cast("string"), F.lit(" for a fill on "), F.col("session_date").cast("string"))).cast("date"))
    return signals.withColumn("information_at", guard.otherwise(F.col("information_at")))


def clamp(weights: DataFrame, members: DataFrame, *, max_gross: float = 1.0) -> DataFrame:
    """weights (strategy, session_date, symbol, weight) of members (session_date, symbol) that are numbers, scaled back
    where their gross is above max_gross."""
    known = weights.where(F.col("weight").isNotNull() & ~F.isnan("weight")).join(members.select("session_date", "symbol").distinct(), ["session_date", "symbol"], "left_semi")
    gross = F.sum(F.abs("weight")).over(W.partitionBy("strategy", "session_date"))
    return known.withColumn("weight", F.when(gross > max_gross, F.col("weight") * max_gross / gross).otherwise(F.col("weight")))


def changes(weights: DataFrame, fills: DataFrame) -> DataFrame:
    """strategy, session_date, symbol, weight, previous for all names held now or before; fills: (strategy,
    session_date) of all sessions with a decision, also where the book is empty."""
    require_columns(weights, "strategy", "session_date", "symbol", "weight")
    steps = fills.select("strategy", "session_date").distinct().withColumn("next", F.lead("session_date").over(W.partitionBy("strategy").orderBy("session_date")))
    before = weights.join(steps, ["strategy", "session_date"]).where("next is not null").select("strategy", F.col("next").alias("session_date"), "symbol", F.col("weight").alias("previous"))
    both = weights.select("strategy", "session_date", "symbol", "weight").join(before, ["strategy", "session_date", "symbol"], "full")
    return both.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "previous": F.coalesce("previous", F.lit(0.0)), "held": F.col("weight").isNotNull()})


def accruals(moves: DataFrame, prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """moves with what each name earns: the carried part from the close of the session before, the rest from the open;
    without that close all from the open; nothing without an open and a close, or for names that leave."""
    numbered = prices.join(calendar, "session_date").select("session_date", "symbol", "session_idx", "open", "close", "turnover_inr")
    prior = numbered.select("symbol", (F.col("session_idx") + 1).alias("session_idx"), F.col("close").alias("prior_close"))
    priced = numbered.join(prior, ["symbol", "session_idx"], "left").drop("session_idx")
    rows = moves.join(priced, ["session_date", "symbol"], "left")
    w, p = F.col("weight"), F.col("previous")
    carried = F.when(w * p > 0, F.when(w >= 0, F.least(p, w)).otherwise(F.greatest(p, w))).otherwise(F.lit(0.0))
    carried = F.when(F.col("prior_close") > 0, carried).otherwise(F.lit(0.0))
    earned = carried * (F.try_divide("close", "prior_close") - 1)
    earned = F.coalesce(earned, F.lit(0.0)) + (w - carried) * (F.try_divide("close", "open") - 1)
    quoted = F.col("held") & (F.col("open") > 0) & F.coalesce(F.col("close") != 0, F.lit(False))
    return rows.withColumn("earned", F.when(quoted, earned).otherwise(F.lit(0.0)))


def gross(weights: DataFrame, fills: DataFrame, prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """strategy, session_date, gross_return, gross_exposure, turnover for every fill."""
    rows = accruals(changes(weights, fills), prices, calendar)
    sums = rows.groupBy("strategy", "session_date").agg(F.sum("earned").alias("gross_return"), F.sum(F.abs("weight")).alias("gross_exposure"), F.sum(F.abs(F.col("weight") - F.col("previous"))).alias("turnover"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("gross_return", "gross_exposure", "turnover")}
    return fills.select("strategy", "session_date").distinct().join(sums, ["strategy", "session_date"], "left").withColumns(zero)


def net(weights: DataFrame, fills: DataFrame, prices: DataFrame, calendar: DataFrame, *, initial: float = 1_000_000.0, depository: float = 0.0, schedule: tuple[C.Epoch, ...] = C.SCHEDULE) -> DataFrame:
    """gross() with cost, net_return and equity; a strategy ends with the first session that leaves it nothing.

    A leg's cost depends on the equity of its day, so sessions are folded in order, a strategy a group; a session's legs
    (absolute change, traded value, side, statutory rate) are one vector.
    """
    rows = accruals(changes(weights, fills), prices, calendar).withColumn("d", F.abs(F.col("weight") - F.col("previous")))
    sells = F.col("weight") < F.col("previous")
    unit = C.charge(F.lit(1.0), sells, C.epoch_of(F.col("session_date"), schedule), F.lit(0))["total"]
    legs = rows.select("strategy", "session_date", "earned", F.abs("weight").alias("x"), "d", F.coalesce("turnover_inr", F.lit(0.0)).alias("v"), sells.alias("sells"), F.when(F.col("d") > 0, unit).alias("rate"))
    # A day without a leg still has a row.
    days = fills.select("strategy", "session_date").distinct().join(legs, ["strategy", "session_date"], "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["session_date", "d", "v", "rate"], kind="stable").fillna({"earned": 0.0, "x": 0.0, "d": 0.0, "v": 0.0, "rate": 0.0, "sells": False})
        day, first = np.unique(pdf["session_date"].to_numpy(), return_index=True)
        g, x, d, v, rate = (pdf[c].to_numpy(float) for c in ("earned", "x", "d", "v", "rate"))
        flat = np.where(pdf["sells"].to_numpy(bool) & (d > 0), float(depository), 0.0)
        sums = [np.add.reduceat(a, first) for a in (g, x, d)]
        ends, e, out = [*first[1:], len(pdf)], float(initial), []
        for i, (a, b) in enumerate(zip(first, ends)):
            if e <= 0:
                break
            some = d[a:b] > 0
            q, value = d[a:b][some], v[a:b][some]
            part = np.divide(q * e, value, out=np.zeros_like(q), where=value > 0)
            slip = np.where(value > 0, np.minimum(C.SLIPPAGE * part, C.MOST_SLIPPAGE), C.MOST_SLIPPAGE)
            cost = float((q * (rate[a:b][some] + slip + C.IMPACT * C.SIGMA * np.sqrt(part)) + flat[a:b][some] / e).sum())
            e *= 1 + sums[0][i] - cost
            out.append((day[i], sums[0][i], sums[1][i], sums[2][i], cost, sums[0][i] - cost, e))
        made = pd.DataFrame(out, columns=["session_date", "gross_return", "gross_exposure", "turnover", "cost", "net_return", "equity"])
        made.insert(0, "strategy", pdf["strategy"].iloc[0])
        return made

    return days.groupBy("strategy").applyInPandas(fold, "strategy string, session_date date, gross_return double, gross_exposure double, turnover double, cost double, net_return double, equity double")


def breaches(weights: DataFrame, fills: DataFrame, prices: DataFrame, result: DataFrame, *, initial: float = 1_000_000.0, limit: float = 0.01) -> DataFrame:
    """strategy, session_date, symbol, participation of legs above the limit, at the equity before the session."""
    order = W.partitionBy("strategy").orderBy("session_date")
    equity = result.select("strategy", "session_date", F.coalesce(F.lag("equity").over(order), F.lit(initial)).alias("before"))
    legs = changes(weights, fills).withColumn("d", F.abs(F.col("weight") - F.col("previous"))).where("d > 0")
    priced = legs.join(prices.select("session_date", "symbol", "turnover_inr"), ["session_date", "symbol"]).where("turnover_inr > 0").join(equity, ["strategy", "session_date"])
    return priced.withColumn("participation", F.col("d") * F.col("before") / F.col("turnover_inr")).where(F.col("participation") > limit).select("strategy", "session_date", "symbol", "participation")


def until_ruin(results: DataFrame) -> DataFrame:
    """results (strategy, session_date, equity) up to the first session that leaves a strategy nothing, with it."""
    ruin = F.min(F.when(F.col("equity") <= 0, F.col("session_date"))).over(W.partitionBy("strategy"))
    return results.withColumn("__ruin", ruin).where(F.col("__ruin").isNull() | (F.col("session_date") <= F.col("__ruin"))).drop("__ruin")


def rebalance_costs(weights: DataFrame, fills: DataFrame, prices: DataFrame, equity: float, *, depository: float = 0.0, schedule: tuple[C.Epoch, ...] = C.SCHEDULE) -> DataFrame:
    """strategy, session_date, symbol, side, share: what each leg of a rebalance costs, as a share of the equity."""
    moved = changes(weights, fills).withColumn("d", F.abs(F.col("weight") - F.col("previous"))).where("d > 0")
    priced = moved.join(prices.select("session_date", "symbol", "turnover_inr"), ["session_date", "symbol"], "left")
    rows = priced.withColumns({"on": F.col("session_date"), "turnover": F.col("d") * equity, "side": F.when(F.col("weight") < F.col("previous"), "sell").otherwise("buy"), "traded_value": F.col("turnover_inr"), "scrips": F.lit(1)})
    return C.execute(rows, depository=depository, schedule=schedule).select("strategy", "session_date", "symbol", "side", (F.col("total") / equity).alias("share"))


def flagged_holdings(weights: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows of held names inside a flagged interval, once for each reason."""
    f = flags.select("symbol", "start_date", "end_date", "reason")
    return weights.join(f, "symbol").where(F.col("session_date").between(F.col("start_date"), F.col("end_date"))).drop("start_date", "end_date")


def positions(weights: DataFrame) -> DataFrame:
    """strategy, session_date, names, gross, net, largest of the weights after clamping."""
    w = F.col("weight")
    return weights.groupBy("strategy", "session_date").agg(F.count("*").alias("names"), F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.max(F.abs(w)).alias("largest"))
