"""Decay of a book's returns, turnover, and how much money its trades can hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.functions.checks import DataIntegrityError, require_columns


def decay_curve(weights: DataFrame, forward: DataFrame, horizons: tuple[int, ...], *, spacing: int = 1) -> DataFrame:
    """factor, horizon, mean_per_session, standard_error, n, n_independent: books' returns per session held.

    All horizons come from one join. The error divides by the number of books that do not overlap.
    """
    require_columns(weights, "session_date", "factor", "symbol", "weight")
    joined = weights.join(forward.select("session_date", "symbol", *[f"fwd_{h}" for h in horizons]), ["session_date", "symbol"])
    books = joined.groupBy("factor", "session_date").agg(*[F.sum(F.col("weight") * F.col(f"fwd_{h}")).alias(f"{h}") for h in horizons])
    long = books.unpivot(["factor", "session_date"], [f"{h}" for h in horizons], "horizon", "book").where("book is not null")
    long = long.withColumn("horizon", F.col("horizon").cast("int"))
    stats = long.groupBy("factor", "horizon").agg(F.avg(F.col("book") / F.col("horizon")).alias("mean_per_session"), F.stddev_samp(F.col("book") / F.col("horizon")).alias("sd"), F.count("*").alias("n"))
    overlap = F.greatest(F.lit(1), F.ceil(F.col("horizon") / F.lit(max(spacing, 1))))
    stats = stats.withColumn("n_independent", F.greatest(F.floor(F.col("n") / overlap), F.lit(1)).cast("bigint"))
    return stats.select("factor", "horizon", "mean_per_session", F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n_independent")).alias("standard_error"), "n", "n_independent")


def half_life(curve: DataFrame) -> DataFrame:
    """factor, half_life: the first horizon whose mean is half of the shortest one's or less; null if that isn't
    positive or it never halves."""
    first = F.min_by("mean_per_session", "horizon").over(W.partitionBy("factor"))
    shortest = F.min("horizon").over(W.partitionBy("factor"))
    staged = curve.withColumns({"base": first, "shortest": shortest})
    halved = (F.col("horizon") > F.col("shortest")) & (F.col("base") > 0) & (F.col("mean_per_session") <= F.col("base") / 2)
    return staged.groupBy("factor").agg(F.min(F.when(halved, F.col("horizon"))).alias("half_life"))


def turnover_by_session(weights: DataFrame, *, at_least: float = 0.0) -> DataFrame:
    """session_date, factor, symbol, traded_fraction: absolute changes of weights from one session of the table to the
    next, entries and exits included; after the last session nothing exits."""
    require_columns(weights, "session_date", "factor", "symbol", "weight")
    days = weights.select("session_date").distinct().withColumn("next_date", F.lead("session_date").over(W.orderBy("session_date")))
    before = weights.join(days, "session_date").where("next_date is not null").select(F.col("next_date").alias("session_date"), "factor", "symbol", F.col("weight").alias("prev_weight"))
    both = weights.join(before, ["session_date", "factor", "symbol"], "full")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("prev_weight", F.lit(0.0)))
    return both.select("session_date", "factor", "symbol", change.alias("traded_fraction")).where(F.col("traded_fraction") > max(at_least, 0.0))


def session_capacity(traded: DataFrame, liquidity: DataFrame, *, participation: float) -> DataFrame:
    """factor, session_date, capacity_inr, binding_symbol, n_names, second_capacity: the money at which the tightest
    (and the next) name of a rebalance reaches its share of trailing traded value."""
    if participation <= 0:
        raise DataIntegrityError("the participation limit must be positive")
    joined = traded.join(liquidity.select("session_date", "symbol", "adv_inr"), ["session_date", "symbol"]).where("adv_inr > 0")
    named = joined.withColumn("name_capacity", participation * F.col("adv_inr") / F.col("traded_fraction"))
    order = W.partitionBy("factor", "session_date").orderBy("name_capacity", "symbol")
    ranked = named.withColumn("r", F.row_number().over(order))
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    return ranked.groupBy("factor", "session_date").agg(pick("name_capacity", 1).alias("capacity_inr"), pick("symbol", 1).alias("binding_symbol"), F.count("*").alias("n_names"), pick("name_capacity", 2).alias("second_capacity"))


def summarise_capacity(per_session: DataFrame, *, ratio: float = 2.0) -> DataFrame:
    """One row for each factor: binding, entry, median, 5 % and 95 % capacity, sessions, the share bound by one name,
    and the median capacity without it."""
    one = F.coalesce(F.col("second_capacity") > ratio * F.col("capacity_inr"), F.lit(False))
    out = per_session.groupBy("factor").agg(
        F.min("capacity_inr").alias("binding_capacity"),
        F.min_by("capacity_inr", "session_date").alias("entry_capacity"),
        F.median("capacity_inr").alias("median_capacity"),
        F.percentile("capacity_inr", 0.05).alias("p05_capacity"),
        F.percentile("capacity_inr", 0.95).alias("p95_capacity"),
        F.count("*").alias("n_sessions"),
        F.avg(one.cast("double")).alias("bound_by_one_name"),
        F.median("second_capacity").alias("median_relaxed"),
    )
    return out.withColumn("relaxed_over_constrained", F.try_divide("median_relaxed", "median_capacity"))


def capacity_by_state(per_session: DataFrame, states: DataFrame) -> DataFrame:
    """factor, flow_state, median and 5 % (nearest rank) capacity, sessions."""
    joined = per_session.join(states.select("session_date", "flow_state"), "session_date").where("flow_state is not null")
    group = W.partitionBy("factor", "flow_state")
    placed = joined.withColumns({"i": F.row_number().over(group.orderBy("capacity_inr", "session_date")) - 1, "n": F.count("*").over(group)})
    nearest = F.max(F.when(F.col("i") == F.round((F.col("n") - 1) * 0.05), F.col("capacity_inr")))
    return placed.groupBy("factor", "flow_state").agg(F.median("capacity_inr").alias("median_capacity"), nearest.alias("p05_capacity"), F.count("*").alias("n_sessions"))


def flow_ratio(by_state: DataFrame) -> DataFrame:
    """factor, ratio of the median capacities of outflow and inflow sessions."""
    wide = by_state.groupBy("factor").pivot("flow_state", ["inflow", "outflow"]).agg(F.first("median_capacity"))
    return wide.select("factor", F.try_divide("outflow", "inflow").alias("ratio"))


def flow_states(net: DataFrame, *, window: int = 5, baseline: int = 252, threshold: float = 1.0) -> DataFrame:
    """net (session_date, net) with rolling, z and flow_state. The baseline ends before the session's own. A series
    of sessions is ordered in one task; it has a row a day."""
    require_columns(net, "session_date", "net")
    order = W.orderBy("session_date")
    frame, past = order.rowsBetween(-window + 1, 0), order.rowsBetween(-baseline, -1)
    staged = net.withColumn("rolling", F.when(F.count("net").over(frame) >= window, F.sum("net").over(frame)))
    full = F.count("rolling").over(past) >= baseline
    staged = staged.withColumns({"mean": F.when(full, F.avg("rolling").over(past)), "sd": F.when(full, F.stddev_samp("rolling").over(past))})
    staged = staged.withColumn("z", F.when(F.col("sd") > 0, (F.col("rolling") - F.col("mean")) / F.col("sd")))
    state = F.when(F.col("z").isNull(), F.lit(None).cast("string")).when(F.col("z") >= threshold, "inflow").when(F.col("z") <= -threshold, "outflow").otherwise("neutral")
    return staged.withColumn("flow_state", state)


def net_positions(participants: DataFrame, category: str = "FII") -> DataFrame:
    """session_date, net contracts of a category, from its two total columns."""
    long, short = "Total Long Contracts", "Total Short Contracts"
    wide = participants.where(F.col("category") == category).groupBy("session_date").pivot("measure", [long, short]).agg(F.sum("contracts"))
    return wide.select("session_date", (F.col(long) - F.col(short)).alias("net"))


def elasticity(measures: DataFrame, *, min_sessions: int) -> DataFrame:
    """symbol, delta, intercept, r_squared, n of log absolute return on log relative value, by symbol."""
    usable = measures.where("abs_ret > 0 and rel_value > 0").select("symbol", F.ln("abs_ret").alias("y"), F.ln("rel_value").alias("x"))
    fit = usable.groupBy("symbol").agg(F.regr_slope("y", "x").alias("delta"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r_squared"), F.count("*").alias("n"))
    return fit.where(F.col("n") >= min_sessions)


def slopes(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """slope, its standard error, r_squared and n by group."""
    fit = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_r2(y, x).alias("r_squared"), F.count("*").alias("n"))
    left = F.col("syy") - F.try_divide(F.col("sxy") ** 2, F.col("sxx"))
    error = F.when(F.col("n") > 2, F.sqrt(F.greatest(F.try_divide(F.try_divide(left, F.col("n") - 2), F.col("sxx")), F.lit(0.0))))
    return fit.select(*by, "slope", error.alias("standard_error"), "r_squared", "n")


def pooled(fits: DataFrame) -> DataFrame:
    """Inverse-variance and equal-weight means of slopes with errors, the median error, and the smallest effect that
    the pooled error can tell from nothing at two sides of 5 % and a power of 80 %."""
    w = 1 / F.col("standard_error") ** 2
    sums = fits.where("standard_error > 0").agg(F.sum(w).alias("w"), F.sum(w * F.col("slope")).alias("ws"), F.avg("slope").alias("mean"), F.stddev_samp("slope").alias("sd"), F.count("*").alias("n"), F.median("standard_error").alias("median_error"))
    error = 1 / F.sqrt("w")
    return sums.select((F.col("ws") / F.col("w")).alias("pooled"), error.alias("pooled_error"), F.col("mean").alias("equal_weight"), (F.col("sd") / F.sqrt("n")).alias("equal_weight_error"), "median_error", (error * (1.959963984540054 + 0.8416212335729143)).alias("detectable"), "n")


def amihud(measures: DataFrame) -> DataFrame:
    """symbol, amihud: mean absolute return over traded value, of sessions with a value."""
    return measures.groupBy("symbol").agg(F.avg("amihud_term").alias("amihud"))


def spread(df: DataFrame, value: str, *, below: float) -> DataFrame:
    """One row: the share of values below a bound, the decades between the least and the greatest, and the quartiles."""
    v = F.col(value)
    return df.agg(F.avg((v < below).cast("double")).alias("share"), F.log10(F.max(v) / F.min(v)).alias("decades"), F.percentile(v, 0.25).alias("lower"), F.percentile(v, 0.75).alias("upper"))


def participation(order: Column, traded_value: Column) -> Column:
    """Share of the traded value; null without any."""
    return F.when(traded_value > 0, order / traded_value)


def square_root_impact(share: Column, sigma: Column, coefficient: float = 1.0) -> Column:
    return coefficient * sigma * F.sqrt(share)


def impact_fraction(participation: float, sigma: float, coefficient: float = 1.0) -> float:
    return coefficient * sigma * math.sqrt(participation)
