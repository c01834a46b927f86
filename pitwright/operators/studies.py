"""Studies of many strategies: layers of an audit, survivors, gross against net, characteristics, exposures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.functions import statistics
from pitwright.functions.checks import DataIntegrityError
from pitwright.operators.features import by_symbol

ACCEPT = 0.95


def statistical_layer(returns: DataFrame, by: str = "strategy", *, accept: float = ACCEPT, trials: int | None = None) -> DataFrame:
    """moments() of each series with threshold, psr, dsr (all of ratios per observation) and rejected: a deflated ratio
    below `accept`, or none at all."""
    out = statistics.deflate(statistics.moments(returns, [by], "ret"), trials)
    return out.withColumn("rejected", F.coalesce(F.col("dsr") < accept, F.lit(True)))


def soundness(layers: DataFrame, names: list[str]) -> DataFrame:
    """layers with signs (1 passed, -1 rejected, 0 not scored) of the named boolean columns (true: rejected) and score,
    their mean."""
    sign = lambda c: F.when(F.col(c).isNull(), 0).when(F.col(c), -1).otherwise(1)
    total = sum((sign(c) for c in names[1:]), sign(names[0]))
    return layers.withColumns({f"{c}_sign": sign(c) for c in names}).withColumn("score", total / float(len(names)))


def survivors(evaluated: DataFrame, traded: DataFrame, rejected: DataFrame, layers: list[str]) -> DataFrame:
    """evaluated (name) with survived: it traded, and none of the chosen layers rejected it. rejected: (name, layer)."""
    t = traded.select("name").distinct().withColumn("traded", F.lit(True))
    bad = rejected.where(F.col("layer").isin(layers)).select("name").distinct().withColumn("bad", F.lit(True))
    out = evaluated.select("name").distinct().join(t, "name", "left").join(bad, "name", "left")
    return out.select("name", (F.col("traded").isNotNull() & F.col("bad").isNull()).alias("survived"))


def redundancy_power(pairs: int, rate: float) -> float:
    """Probability that no pair of `pairs` is a duplicate where each is one at that rate."""
    return (1 - rate) ** pairs


def cross_arm_share(clusters: DataFrame) -> DataFrame:
    """One row: clusters of several members, and how many of them have members of several arms. clusters: (name, arm,
    cluster)."""
    per = clusters.groupBy("cluster").agg(F.count("*").alias("members"), F.count_distinct("arm").alias("arms")).where("members > 1")
    return per.agg(F.count("*").alias("clusters"), F.count_if(F.col("arms") > 1).alias("across"), F.try_divide(F.count_if(F.col("arms") > 1), F.count("*")).alias("share"))


def nearest(correlations: DataFrame) -> DataFrame:
    """name, nearest, correlation: the most correlated other series of each, equals by name. correlations: (a, b,
    correlation) of unordered pairs."""
    both = correlations.select(F.col("a").alias("name"), F.col("b").alias("other"), "correlation").unionByName(correlations.select(F.col("b").alias("name"), F.col("a").alias("other"), "correlation"))
    order = W.partitionBy("name").orderBy(F.desc_nulls_last("correlation"), "other")
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").select("name", F.col("other").alias("nearest"), "correlation")


def pool(corpora: list[DataFrame], same: list[str]) -> DataFrame:
    """The corpora as one table with corpus (their number); raises unless each column of `same` has one value in all."""
    out = None
    for i, c in enumerate(corpora):
        marked = c.withColumn("corpus", F.lit(i))
        out = marked if out is None else out.unionByName(marked)
    seen = out.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(c) for c in same]).first()
    if wrong := [c for c in same if seen[c] > 1]:
        raise DataIntegrityError(f"the corpora differ in {', '.join(wrong)}")
    return out


def gross_against_net(results: DataFrame) -> DataFrame:
    """strategy, gross_sharpe, net_sharpe, drop, flipped (net loses what gross earned) and ruined (equity at or below 0),
    of daily results (strategy, session_date, gross_return, net_return, equity)."""
    ratio = lambda c: F.when(F.stddev_samp(c) > 1e-12, F.avg(c) / F.stddev_samp(c) * math.sqrt(252)).otherwise(F.lit(0.0))
    out = results.groupBy("strategy").agg(ratio("gross_return").alias("gross_sharpe"), ratio("net_return").alias("net_sharpe"), (F.min("equity") <= 0).alias("ruined"))
    return out.withColumns({"drop": F.col("gross_sharpe") - F.col("net_sharpe"), "flipped": (F.col("gross_sharpe") > 0) & (F.col("net_sharpe") <= 0)})


def depository_sensitivity(legs: DataFrame, charges: dict[str, float], books: list[float]) -> DataFrame:
    """scheme, book, share: what a flat charge a sold name costs, as a share of the book, on average a session. legs:
    (session_date, symbol, change) of a book's weights; each combination is a column expression on one count a session."""
    sold = legs.groupBy("session_date").agg(F.count_if(F.col("change") < 0).alias("n"))
    mean = sold.agg(F.avg("n").alias("n"))
    rows = F.array(*[F.struct(F.lit(s).alias("scheme"), F.lit(float(b)).alias("book"), F.lit(float(c)).alias("charge")) for s, c in charges.items() for b in books])
    return mean.select("n", F.explode(rows).alias("x")).select("x.scheme", "x.book", (F.col("n") * F.col("x.charge") / F.col("x.book")).alias("share"))


def baskets(panel: DataFrame) -> DataFrame:
    """session_date, equal_weight, by_turnover: mean returns of all names, equal or by the turnover of the session
    before."""
    before = F.lag("turnover_inr").over(by_symbol())
    ret = F.try_divide("adj_close", F.lag("adj_close").over(by_symbol())) - 1
    rows = panel.withColumns({"r": ret, "w": before}).where("r is not null and w is not null")
    return rows.groupBy("session_date").agg(F.avg("r").alias("equal_weight"), F.try_divide(F.sum(F.col("r") * F.col("w")), F.sum("w")).alias("by_turnover"))


def error_decomposition(returns: DataFrame, index: DataFrame) -> DataFrame:
    """One row: the deviations of index less equal-weight basket, index less turnover basket, and between the baskets.
    returns: baskets(); index: (session_date, ret)."""
    both = returns.join(index, "session_date")
    gap = lambda a, b: F.stddev_samp(F.col(a) - F.col(b)) * math.sqrt(252)
    return both.agg(gap("ret", "equal_weight").alias("to_equal_weight"), gap("ret", "by_turnover").alias("to_turnover"), gap("equal_weight", "by_turnover").alias("between"), F.count("*").alias("n"))


def concentration(weights: DataFrame) -> DataFrame:
    """strategy, herfindahl (mean over sessions of the sum of squared shares of gross), names (mean)."""
    share = F.abs("weight") / F.sum(F.abs("weight")).over(W.partitionBy("strategy", "session_date"))
    per = weights.withColumn("s", share).groupBy("strategy", "session_date").agg(F.sum(F.col("s") * F.col("s")).alias("h"), F.count("*").alias("n"))
    return per.groupBy("strategy").agg(F.avg("h").alias("herfindahl"), F.avg("n").alias("names"))


def holding_period(weights: DataFrame) -> DataFrame:
    """strategy, holding_period: sessions held over entries; a name enters where it was not held the session before."""
    days = weights.select("strategy", "session_date").distinct()
    days = days.withColumn("before", F.lag("session_date").over(W.partitionBy("strategy").orderBy("session_date")))
    order = W.partitionBy("strategy", "symbol").orderBy("session_date")
    held = weights.join(days, ["strategy", "session_date"]).withColumn("own", F.lag("session_date").over(order))
    entries = F.count_if(~F.col("own").eqNullSafe(F.col("before")) | F.col("before").isNull())
    return held.groupBy("strategy").agg((F.count("*") / entries).alias("holding_period"))


def book_similarity(weights: DataFrame, lags: tuple[int, ...] = (5, 21, 63)) -> DataFrame:
    """strategy, lag, similarity: mean cosine between a session's book and that of `lag` sessions of the strategy before."""
    turn = F.row_number().over(W.partitionBy("strategy").orderBy("session_date"))
    days = weights.select("strategy", "session_date").distinct().withColumn("i", turn)
    rows = weights.join(days, ["strategy", "session_date"]).select("strategy", "i", "symbol", "weight")
    norm = rows.groupBy("strategy", "i").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    lagged = F.explode(F.array(*[F.lit(n) for n in lags])).alias("lag")
    later = rows.select("strategy", F.col("i").alias("j"), "symbol", F.col("weight").alias("w2"), lagged).withColumn("i", F.col("j") - F.col("lag"))
    dots = rows.join(later, ["strategy", "i", "symbol"]).groupBy("strategy", "i", "lag").agg(F.sum(F.col("weight") * F.col("w2")).alias("dot"))
    pairs = norm.select("strategy", "i", "norm", lagged).join(norm.select("strategy", F.col("i").alias("j"), F.col("norm").alias("norm2")), "strategy").where("j = i + lag")
    cosine = F.coalesce(F.try_divide("dot", F.col("norm") * F.col("norm2")), F.lit(0.0))
    return pairs.join(dots, ["strategy", "i", "lag"], "left").groupBy("strategy", "lag").agg(F.avg(cosine).alias("similarity"), F.count("*").alias("n"))


def univariate_betas(returns: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """strategy and a beta for each factor by itself. factors: (session_date, names)."""
    both = returns.join(factors, "session_date")
    return both.groupBy("strategy").agg(*[F.try_divide(F.covar_samp("ret", n), F.var_samp(n)).alias(f"beta_{n}") for n in names])


def joint_betas(returns: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """strategy, alpha, a beta for each factor jointly, r_squared and condition (of the standardised factors). A strategy's
    sessions are summed to cross products first, so a group is one row."""
    x = ["one", *names]
    both = returns.join(factors, "session_date").withColumn("one", F.lit(1.0)).dropna(subset=["ret", *names])
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for i, a in enumerate(x) for b in x[i:]] + [F.sum(F.col(a) * F.col("ret")).alias(f"{a}|ret") for a in x] + [F.sum(F.col("ret") ** 2).alias("ret|ret")]
    rows = both.groupBy("strategy").agg(*sums)
    fields = ["alpha", *[f"beta_{n}" for n in names], "r_squared", "condition"]

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                a = np.array([[row[f"{p}|{q}"] if f"{p}|{q}" in row else row[f"{q}|{p}"] for q in x] for p in x])
                b = np.array([row[f"{p}|ret"] for p in x])
                n = a[0, 0]
                beta = np.linalg.lstsq(a, b, rcond=None)[0]
                cov = a[1:, 1:] / n - np.outer(a[0, 1:], a[0, 1:]) / n**2
                sd = np.sqrt(np.diag(cov))
                corr = cov / np.outer(sd, sd) if (sd > 0).all() else np.full_like(cov, np.nan)
                total = row["ret|ret"] - b[0] ** 2 / n
                left = row["ret|ret"] - 2 * beta @ b + beta @ a @ beta
                out.append([row["strategy"], *beta, 1 - left / total if total > 0 else np.nan, np.sqrt(np.linalg.cond(corr)) if np.isfinite(corr).all() else np.nan])
            yield pd.DataFrame(out, columns=["strategy", *fields])

    return rows.mapInPandas(solve, "strategy string, " + ", ".join(f"{f} double" for f in fields))


def split_half(rows: DataFrame, calendar: DataFrame, fit) -> DataFrame:
    """symbol, first, second: a statistic of each half of the calendar's sessions. fit: rows and keys to a table of the
    keys and `value`."""
    middle = calendar.agg(F.floor((F.max("session_idx") + 1) / 2).alias("middle"))
    halves = rows.join(calendar, "session_date").join(F.broadcast(middle)).withColumn("half", F.when(F.col("session_idx") < F.col("middle"), "first").otherwise("second"))
    return fit(halves, ["symbol", "half"]).groupBy("symbol").pivot("half", ["first", "second"]).agg(F.first("value")).where("first is not null and second is not null")


def exposure_strata(results: DataFrame, *, near_cash: float = 0.10) -> DataFrame:
    """strategy, median_gross, stratum: near_cash where the median gross exposure is below a share, else invested."""
    out = results.groupBy("strategy").agg(F.median("gross_exposure").alias("median_gross"))
    return out.withColumn("stratum", F.when(F.col("median_gross") < near_cash, "near_cash").otherwise("invested"))


def disagreements(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: rows compared, the largest absolute difference, rows that only one run has. For replicates and paths that
    must reproduce the original."""
    a, b = first.select(*keys, F.col(value).alias("a")), second.select(*keys, F.col(value).alias("b"))
    both = a.join(b, keys, "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("compared"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"))


def adv(panel: DataFrame, n: int) -> Column:
    """Mean value of the last n quotations before the row's own, as many as there are: traded_value, else close times
    volume."""
    value = F.col("traded_value") if "traded_value" in panel.columns else F.col("close") * F.col("volume")
    return F.avg(value).over(by_symbol().rowsBetween(-n, -1))


def token_accounting(draws: DataFrame) -> DataFrame:
    """arm, tokens, accepted, tokens_per_accepted of draws (arm, tokens, accepted); null without an accepted one."""
    out = draws.groupBy("arm").agg(F.sum("tokens").alias("tokens"), F.count_if("accepted").alias("accepted"))
    return out.withColumn("tokens_per_accepted", F.when(F.col("accepted") > 0, F.col("tokens") / F.col("accepted")))


def matched_draws(*, budget: float, cost: float) -> int:
    """Draws at a cost that a budget pays for, one at least."""
    return max(1, int(budget // cost))
