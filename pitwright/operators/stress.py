"""Regimes, bootstrap paths, synthetic panels and fragility; a path is a key, so all paths are one job."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.operators.backtest import gross
from pitwright.operators.features import long_short
from pitwright.operators.frames import uniform

WINDOW = 21
DAYS = 252


def regime_features(index: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """session_date, log_vol, trend of an index (session_date, close): trailing annualised log volatility and log
    return. Sessions with a volatility of zero, or before the window is full, are left out."""
    order = W.orderBy("session_date")
    frame = order.rowsBetween(-window + 1, 0)
    r = index.withColumn("r", F.ln(F.try_divide("close", F.lag("close").over(order))))
    full = F.count("r").over(frame) >= window
    out = r.withColumns({"vol": F.when(full, F.stddev_samp("r").over(frame) * math.sqrt(DAYS)), "trend": F.when(full, F.sum("r").over(frame))})
    return out.where("vol > 0").select("session_date", F.ln("vol").alias("log_vol"), "trend")


def fit_mixture(x: np.ndarray, k: int, seed: int, *, restarts: int = 8, steps: int = 200) -> dict[str, np.ndarray]:
    """A Gaussian hidden Markov model with diagonal covariances by expectation and maximisation, the best of some
    seeded starts; states in order of their first mean."""
    best, most = {}, -math.inf
    for restart in range(restarts):
        rng = np.random.default_rng(seed + 1000 * restart)
        mean = x[rng.choice(len(x), k, replace=False)].astype(float)
        var = np.tile(x.var(axis=0) + 1e-6, (k, 1))
        start, move = np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1))
        np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
        last = -math.inf
        for _ in range(steps):
            like = log_likelihood(x, mean, var)
            top = like.max(axis=1, keepdims=True)
            b = np.exp(like - top)
            a, scale = np.empty_like(b), np.empty(len(x))
            for t in range(len(x)):
                p = (start if t == 0 else a[t - 1] @ move) * b[t]
                scale[t] = max(p.sum(), 1e-300)
                a[t] = p / scale[t]
            back = np.ones_like(b)
            for t in range(len(x) - 2, -1, -1):
                back[t] = move @ (b[t + 1] * back[t + 1]) / scale[t + 1]
            g = a * back
            g /= g.sum(axis=1, keepdims=True)
            pairs = move * (a[:-1].T @ (b[1:] * back[1:] / scale[1:, None]))
            start, move = g[0] + 1e-12, pairs + 1e-12
            start, move = start / start.sum(), move / move.sum(axis=1, keepdims=True)
            w = g.sum(axis=0)[:, None] + 1e-12
            mean = g.T @ x / w
            var = np.maximum(g.T @ x**2 / w - mean**2, 1e-6)
            total = float((np.log(scale) + top[:, 0]).sum())
            if abs(total - last) < 1e-6 * abs(total):
                break
            last = total
        if total > most:
            order = np.argsort(mean[:, 0], kind="stable")
            most, best = total, {"start": start[order], "move": move[np.ix_(order, order)], "mean": mean[order], "var": var[order], "evidence": np.array(total)}
    return best


def log_likelihood(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (((x[:, None, :] - mean) ** 2 / var) + np.log(2 * np.pi * var)).sum(axis=2)


def forward_filter(model: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered state probabilities, each from the rows up to its own, and the log evidence."""
    like = log_likelihood(x, model["mean"], model["var"])
    out, evidence = np.empty_like(like), 0.0
    for t in range(len(x)):
        top = like[t].max()
        p = (model["start"] if t == 0 else out[t - 1] @ model["move"]) * np.exp(like[t] - top)
        total = max(p.sum(), 1e-300)
        evidence += math.log(total) + top
        out[t] = p / total
    return out, evidence


def regime_labels(features: DataFrame, refits: list[str], *, k: int = 2, seed: int = 42, at_least: int = 504) -> DataFrame:
    """session_date, state, refit_date, n_train: each stretch between refits labelled by a model of the rows before it.

    Stretches are groups of one job; a group has the features of one index up to its end, a row a day."""
    ends = [*refits[1:], "9999-12-31"]
    stretch = F.explode(F.array(*[F.struct(F.lit(a).cast("date").alias("refit_date"), F.lit(b).cast("date").alias("until")) for a, b in zip(refits, ends)])).alias("s")
    rows = features.select("session_date", "log_vol", "trend", stretch).select("session_date", "log_vol", "trend", "s.refit_date", "s.until").where("session_date < until")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session_date")
        past = (pdf["session_date"] < pdf["refit_date"]).to_numpy()
        if past.sum() < max(at_least, k) or past.all():
            return pd.DataFrame({"session_date": pdf["session_date"][:0], "state": np.zeros(0, "int32"), "refit_date": pdf["refit_date"][:0], "n_train": np.zeros(0, "int64")})
        x = pdf[["log_vol", "trend"]].to_numpy(float)
        states = forward_filter(fit_mixture(x[past], k, seed), x)[0].argmax(axis=1)
        return pd.DataFrame({"session_date": pdf["session_date"][~past], "state": states[~past].astype("int32"), "refit_date": pdf["refit_date"][~past], "n_train": int(past.sum())})

    return rows.groupBy("refit_date").applyInPandas(label, "session_date date, state int, refit_date date, n_train bigint")


def information_criterion(evidence: float, n: int, k: int, dimensions: int) -> float:
    free = (k - 1) + k * (k - 1) + 2 * k * dimensions
    return free * math.log(n) - 2 * evidence


def bootstrap_paths(spark: SparkSession, n: int, paths: int, block: float, seed: int, labels: DataFrame | None = None) -> DataFrame:
    """path_id, step, src_idx: stationary bootstrap with blocks of geometric length, wrapped around. With labels
    (session_idx, label) a jump goes to a session of the label of the step.

    A draw is a hash of the seed, the path and the step, so paths are drawn apart, and again alike, without Python."""
    if n < 1 or block < 1:
        raise ValueError("n and block must be 1 at least")
    rows = spark.range(paths).select(F.col("id").alias("path_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"))
    rows = rows.withColumn("jump", (F.col("step") == 0) | (uniform(seed, F.col("path_id"), F.col("step"), "jump") < 1 / block))
    draw = uniform(seed, F.col("path_id"), F.col("step"), "to")
    if labels is None:
        rows = rows.withColumn("to", F.floor(draw * n))
    else:
        own = W.partitionBy("label")
        placed = labels.select(F.col("session_idx").alias("to"), "label", (F.row_number().over(own.orderBy("session_idx")) - 1).alias("place"), F.count("*").over(own).alias("size"))
        sizes = labels.join(placed.select("label", "size").distinct(), "label").select(F.col("session_idx").alias("step"), "label", "size")
        rows = rows.join(sizes, "step").withColumn("place", F.floor(draw * F.col("size"))).join(placed.drop("size"), ["label", "place"])
    last = F.last(F.when(F.col("jump"), F.struct("step", "to")), ignorenulls=True).over(W.partitionBy("path_id").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("last", last).select("path_id", "step", ((F.col("last.to") + F.col("step") - F.col("last.step")) % n).cast("int").alias("src_idx"))


def gather(paths: DataFrame, series: DataFrame) -> DataFrame:
    """paths with the values of the sessions that they point to; series has session_idx."""
    return paths.join(series.withColumnRenamed("session_idx", "src_idx"), "src_idx")


def synthetic_panel(paths: DataFrame, panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """path_id, step, symbol, open, high, low, close, prev_close, volume, turnover_inr, carried: each symbol's first close
    compounded by the log returns of the sessions on its path. The other prices keep their ratio to the close of the
    session that they come from; volume and turnover are that session's. A session into which a symbol has no return
    moves nothing, and is carried. prev_close of the panel, if it has one, else the close before, is scaled alike."""
    order = W.partitionBy("symbol").orderBy("session_date")
    before = F.lag("close").over(order)
    prior = F.col("prev_close") if "prev_close" in panel.columns else before
    moved = panel.join(calendar, "session_date").select("session_idx", "symbol", "open", "high", "low", "close", prior.alias("prev_close"), "volume", "turnover_inr", F.ln(F.try_divide("close", before)).alias("r"))
    anchors = panel.groupBy("symbol").agg(F.min_by("close", "session_date").alias("anchor"))
    rows = gather(paths, moved).join(anchors, "symbol")
    level = F.sum(F.coalesce("r", F.lit(0.0))).over(W.partitionBy("path_id", "symbol").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("level", F.col("anchor") * F.exp(level)).withColumn("scale", F.try_divide("level", "close"))
    scaled = [(F.col(c) * F.col("scale")).alias(c) for c in ("open", "high", "low")]
    return rows.select("path_id", "step", "symbol", *scaled, F.col("level").alias("close"), (F.col("prev_close") * F.col("scale")).alias("prev_close"), "volume", "turnover_inr", F.col("r").isNull().alias("carried"))


def panel_diagnostics(synthetic: DataFrame, members: DataFrame) -> DataFrame:
    """One row a path: expected (members of its steps), missing (those without a row), carried rows, and the largest move
    between neighbouring rows of a symbol. members: (step, symbol)."""
    order = W.partitionBy("path_id", "symbol").orderBy("step")
    moves = synthetic.withColumn("move", F.abs(F.try_divide("close", F.lag("close").over(order)) - 1))
    own = moves.groupBy("path_id").agg(F.count_if("carried").alias("carried"), F.max("move").alias("max_move"))
    wanted = synthetic.select("path_id").distinct().join(members.groupBy().agg(F.count("*").alias("expected")))
    found = synthetic.join(members, ["step", "symbol"]).groupBy("path_id").agg(F.count("*").alias("found"))
    return wanted.join(found, "path_id", "left").join(own, "path_id").select("path_id", "expected", (F.col("expected") - F.coalesce("found", F.lit(0))).alias("missing"), "carried", "max_move")


def masked(synthetic: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of members (step, symbol) only."""
    return synthetic.join(members.select("step", "symbol"), ["step", "symbol"], "left_semi")


def rerun(synthetic: DataFrame, calendar: DataFrame, scores: Callable[[DataFrame], DataFrame], *, quantile: float = 0.2, scale: float = 1.0) -> DataFrame:
    """path_id, session_date, gross_return, gross_exposure, turnover of a long-short strategy that decides anew on each
    path's panel. All paths are one job: a path's names are names of their own (PATH/NAME), its cross-sections those of a
    factor of its own, and it is a strategy. scores: a panel (session_date, symbol, prices, adj_close) to (session_date,
    symbol, score)."""
    steps = calendar.select(F.col("session_idx").alias("step"), "session_date")
    named = synthetic.join(steps, "step").withColumns({"adj_close": F.col("close"), "symbol": F.concat(F.col("path_id").cast("string"), F.lit("/"), F.col("symbol"))})
    fills = calendar.withColumn("fill", F.lead("session_date").over(W.orderBy("session_date"))).where("fill is not null").select("session_date", "fill")
    own = scores(named).withColumn("factor", F.substring_index("symbol", "/", 1))
    books = long_short(own, quantile=quantile).join(fills, "session_date")
    weights = books.select(F.col("factor").alias("strategy"), F.col("fill").alias("session_date"), "symbol", (F.col("weight") * scale).alias("weight"))
    out = gross(weights, weights.select("strategy", "session_date").distinct(), named, calendar)
    return out.withColumn("path_id", F.col("strategy").cast("bigint")).drop("strategy")


def sharpe_by(returns: DataFrame, by: list[str], *, at_least: int = 2) -> DataFrame:
    per = returns.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd")).where((F.col("n") >= at_least) & (F.col("sd") > 1e-12))
    return per.select(*by, "n", (F.col("m") / F.col("sd") * math.sqrt(DAYS)).alias("sharpe"))


def fragility_across_paths(returns: DataFrame, by: list[str], *, floor: float = 0.05) -> DataFrame:
    """by, paths, fragility, near_zero: variance over absolute mean of a strategy's Sharpe ratios on paths."""
    ratios = sharpe_by(returns, [*by, "path_id"])
    out = ratios.groupBy(*by).agg(F.count("*").alias("paths"), F.var_samp("sharpe").alias("v"), F.avg("sharpe").alias("m"))
    return out.select(*by, "paths", F.when((F.col("paths") >= 2) & (F.col("m") != 0), F.col("v") / F.abs("m")).alias("fragility"), ((F.col("paths") < 2) | (F.abs("m") < floor)).alias("near_zero"))


def resampled_fragility(paths: DataFrame, returns: DataFrame, states: DataFrame, by: list[str], *, at_least: int = 21) -> tuple[DataFrame, DataFrame]:
    """Both definitions on returns (by, session_idx, ret) resampled along paths, the decisions held fixed: fragility
    across paths; and the mean over paths of the fragility across regimes, states (session_idx, state) being resampled
    with the returns."""
    drawn = gather(paths, returns.join(states, "session_idx"))
    inside = fragility(drawn, [*by, "path_id"], at_least=at_least)
    return fragility_across_paths(drawn, by), inside.groupBy(*by).agg(F.avg("fragility").alias("mean_fragility"), F.count("fragility").alias("paths"))


def revisions(labels: DataFrame) -> DataFrame:
    """refit_date, n, changed, rate: of the sessions that a refit and the one before it both label, those that it labels
    otherwise. labels: (refit_date, session_date, state), a row for each refit that labels the session."""
    order = W.partitionBy("session_date").orderBy("refit_date")
    both = labels.withColumn("before", F.lag("state").over(order)).where("before is not null")
    return both.groupBy("refit_date").agg(F.count("*").alias("n"), F.count_if(F.col("state") != F.col("before")).alias("changed"), F.avg((F.col("state") != F.col("before")).cast("double")).alias("rate"))


def terminal_disagreement(labels: DataFrame) -> DataFrame:
    """refit_date, n, rate: how often a refit's labels differ from those of the last refit that labels the session."""
    last = F.max_by("state", "refit_date").over(W.partitionBy("session_date"))
    return labels.withColumn("final", last).groupBy("refit_date").agg(F.count("*").alias("n"), F.avg((F.col("state") != F.col("final")).cast("double")).alias("rate"))


def fragility(returns: DataFrame, by: list[str], *, at_least: int = 21, floor: float = 0.05) -> DataFrame:
    """by, regimes, fragility, near_zero: variance over absolute mean of the Sharpe ratios of regimes (by, state, ret)
    with enough sessions; near_zero marks means too small to divide by."""
    per = returns.groupBy(*by, "state").agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd")).where((F.col("n") >= at_least) & (F.col("sd") > 1e-12))
    ratios = per.withColumn("sharpe", F.col("m") / F.col("sd") * math.sqrt(DAYS))
    out = ratios.groupBy(*by).agg(F.count("*").alias("regimes"), F.var_samp("sharpe").alias("v"), F.avg("sharpe").alias("m"))
    usable = F.col("regimes") >= 2
    return out.select(*by, "regimes", F.when(usable & (F.col("m") != 0), F.col("v") / F.abs("m")).alias("fragility"), (~usable | (F.abs("m") < floor)).alias("near_zero"))


def battery(returns: DataFrame, by: list[str], order_by: str = "step") -> DataFrame:
    """Moments of each path: mean, sd, skew, kurtosis (population), autocorrelation of returns, those of their sizes at 1,
    5 and 21 sessions, the 5 % quantile and the largest drawdown (positive)."""
    order = W.partitionBy(*by).orderBy(order_by)
    run = order.rowsBetween(W.unboundedPreceding, 0)
    staged = returns.withColumns({"before": F.lag("ret").over(order), "before_5": F.lag("ret", 5).over(order), "before_21": F.lag("ret", 21).over(order), "equity": F.product(1 + F.col("ret")).over(run)})
    staged = staged.withColumn("fall", 1 - F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(run)))
    return staged.groupBy(*by).agg(
        F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurtosis"),
        F.corr("ret", "before").alias("autocorrelation"), *[F.corr(F.abs("ret"), F.abs(c)).alias(n) for c, n in (("before", "size_autocorrelation"), ("before_5", "size_autocorrelation_5"), ("before_21", "size_autocorrelation_21"))], F.percentile("ret", 0.05).alias("p05"), F.max("fall").alias("max_drawdown"),
    )


def autocovariances(series: DataFrame, most: int) -> DataFrame:
    """lag, covariance of a series (session_idx without holes, ret) at lags 0 to `most`, all divided by its length."""
    level = F.broadcast(series.agg(F.avg("ret").alias("m"), F.count("*").alias("n")))  # one row
    order = W.orderBy("session_idx")
    x = series.join(level).withColumn("x", F.col("ret") - F.col("m"))
    wide = x.select("n", "x", *[F.lag("x", k).over(order).alias(f"l{k}") for k in range(most + 1)])
    sums = wide.agg(*[(F.sum(F.col("x") * F.col(f"l{k}")) / F.max("n")).alias(f"{k}") for k in range(most + 1)])
    return sums.withColumn("one", F.lit(1)).unpivot(["one"], [f"{k}" for k in range(most + 1)], "lag", "covariance").select(F.col("lag").cast("bigint").alias("lag"), "covariance")


def choose_states(x: np.ndarray, ks: tuple[int, ...] = (2, 3, 4), seed: int = 42) -> tuple[int, dict[int, float]]:
    """(number of states of the least criterion, criterion by number) of mixtures fitted to x."""
    found = {k: information_criterion(float(fit_mixture(x, k, seed)["evidence"]), len(x), k, x.shape[1]) for k in ks}
    return min(found, key=lambda k: (found[k], k)), found


BATTERY = ("mean", "sd", "skew", "kurtosis", "autocorrelation", "size_autocorrelation", "size_autocorrelation_5", "size_autocorrelation_21", "p05", "max_drawdown")


def compare_battery(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    """statistic, real, low, high (5 % and 95 % of the paths), percentile (share of paths at or below the real value) and
    inside. Both have a row a series with BATTERY columns; real has one row."""
    long = synthetic.unpivot(["path_id"], list(BATTERY), "statistic", "value").where("value is not null")
    own = real.select(F.lit(0).alias("x"), *BATTERY).unpivot(["x"], list(BATTERY), "statistic", "real").drop("x")
    both = long.join(F.broadcast(own), "statistic")  # ten rows
    out = both.groupBy("statistic", "real").agg(F.percentile("value", 0.05).alias("low"), F.percentile("value", 0.95).alias("high"), F.avg((F.col("value") <= F.col("real")).cast("double")).alias("percentile"))
    return out.withColumn("inside", F.col("real").between(F.col("low"), F.col("high")))


def block_length(returns: np.ndarray) -> tuple[float, int]:
    """(block length, bandwidth) for a stationary bootstrap by the automatic rule of Politis and White (2004)."""
    x = np.asarray(returns, float) - np.mean(returns)
    n = len(x)
    most = int(np.ceil(np.sqrt(n))) + max(5, int(np.log10(n)))
    cov = np.array([x[: n - lag] @ x[lag:] / n for lag in range(min(2 * most, n - 1) + 1)])
    if cov[0] <= 0:
        return 1.0, 1
    limit, run = 2 * math.sqrt(math.log10(n) / n), max(5, int(math.sqrt(math.log10(n))))
    small = np.abs(cov[1:] / cov[0]) < limit
    m = next((lag for lag in range(len(small) - run + 1) if small[lag : lag + run].all()), most)
    width = min(max(1, 2 * m), len(cov) - 1)
    lags = np.arange(-width, width + 1)
    flat = np.minimum(1, 2 * (1 - np.abs(lags) / width))
    c = cov[np.abs(lags)]
    g, d = (flat * np.abs(lags) * c).sum(), 2 * (flat * c).sum() ** 2
    length = (2 * g**2 / d) ** (1 / 3) * n ** (1 / 3) if d > 0 else 1.0
    return float(np.clip(length, 1, 3 * n ** (1 / 3))), width
