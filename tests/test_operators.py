"""Operators that no query's SQL covers whole: errors, identities and small cases by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pitwright.functions import normal
from pitwright.functions.checks import DataIntegrityError
from pitwright.operators import calendar, features, frames, strategies, stress, studies
from pitwright.sources.panels import price_panel

SF = "/root/testdata/sf0.001"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_shift_fails_out_of_range_and_for_days_without_trades(spark):
    cal = calendar.build(spark.createDataFrame([(day(n),) for n in (0, 1, 4)], "session_date date"))
    asked = lambda n: spark.createDataFrame([(day(n),)], "day date")
    assert calendar.shift(asked(1), cal, 1).first().shifted == day(4)
    for start, n in ((4, 1), (0, -1), (2, 1)):
        with pytest.raises(PySparkException, match="session"):
            calendar.shift(asked(start), cal, n).collect()
    assert calendar.shift(asked(4), cal, 1, strict=False).first().shifted is None


def test_normal_cdf_equals_the_error_function(spark):
    xs = [float(x) for x in np.linspace(-40, 40, 401)] + [7.07106781186547, -1e-9]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal.cdf(F.col("x")).alias("p")).collect()
    assert all(math.isclose(r.p, 0.5 * math.erfc(-r.x / math.sqrt(2)), rel_tol=2e-9, abs_tol=1e-14) for r in rows)


def test_macd_weights_are_the_recursion():
    closes = np.random.default_rng(1).random(78) + 1

    def ema(values, span):
        out = [values[0]]
        for v in values[1:]:
            out.append(2 / (span + 1) * v + (1 - 2 / (span + 1)) * out[-1])
        return np.array(out)

    line = ema(closes, 12) - ema(closes, 26)
    assert math.isclose(np.dot(strategies.macd_weights(78, 12, 26, 9), closes), line[-1] - ema(line, 9)[-1], abs_tol=1e-12)


def test_global_rank_equals_a_sort(spark):
    rows = [(i, (i * 7919) % 101) for i in range(1000)]
    got = {r.i: r["rank"] for r in frames.global_rank(spark.createDataFrame(rows, "i int, x int").repartition(5), F.desc("x"), F.asc("i")).collect()}
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want
    assert frames.global_rank(spark.createDataFrame([], "i int, x int"), F.asc("x")).count() == 0


def test_identity_path_reproduces_the_panel(spark):
    panel = price_panel(spark, SF)
    cal = calendar.build(panel)
    path = cal.select(F.lit(0).alias("path_id"), F.col("session_idx").alias("step"), F.col("session_idx").alias("src_idx"))
    made = stress.synthetic_panel(path, panel, cal).join(cal.select(F.col("session_idx").alias("step"), "session_date"), "step")
    both = made.alias("m").join(panel.alias("p"), ["session_date", "symbol"])
    gap = both.agg(*[F.max(F.abs(F.col(f"m.{c}") / F.col(f"p.{c}") - 1)).alias(c) for c in ("open", "high", "low", "close", "volume", "turnover_inr")]).first()
    assert made.count() == both.count() == panel.count() and max(gap) < 1e-9
    members = panel.join(cal, "session_date").select(F.col("session_idx").alias("step"), "symbol")
    report = stress.panel_diagnostics(made, members).first()
    assert (report.expected, report.missing, report.carried) == (panel.count(), 0, panel.select("symbol").distinct().count())
    assert stress.masked(made, members.where("symbol = 'Brand#11'")).select("symbol").distinct().count() == 1


def test_paths_have_the_asked_blocks_and_labels(spark):
    paths = stress.bootstrap_paths(spark, 200, 100, 8.0, 1)
    before = [(r.path_id, r.step, r.src_idx) for r in paths.orderBy("path_id", "step").collect()]
    jumps = sum(b[2] != (a[2] + 1) % 200 for a, b in zip(before, before[1:]) if a[0] == b[0])
    assert len(before) == 20_000 and 0.10 < jumps / 19_900 < 0.15
    labels = spark.createDataFrame([(i, i % 3) for i in range(90)], "session_idx int, label int")
    rows = stress.bootstrap_paths(spark, 90, 20, 1.0, 2, labels)
    assert rows.count() == 1800 and rows.where("src_idx % 3 != step % 3").count() == 0


def test_view_sees_todays_members_past_only(spark):
    panel = spark.createDataFrame([(day(n), s, 1.0) for n in range(6) for s in "ab" if (s, n) != ("b", 3)], "session_date date, symbol string, close double")
    members = spark.createDataFrame([(day(4), "b"), (day(2), "a")], "session_date date, symbol string")
    seen = [(r.session_date, r.symbol) for r in features.view(panel, members, str(day(4)), 2).orderBy("session_date").collect()]
    assert seen == [(day(1), "b"), (day(2), "b")]
    assert features.view(panel, members, str(day(4))).count() == 3


def test_keys_corpora_and_folds(spark):
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    assert [r.k for r in frames.common_keys(k(1, 2), k(2, 3)).collect()] == [2]
    with pytest.raises(DataIntegrityError):
        frames.common_keys(k(1), k(2))
    c = lambda v: spark.createDataFrame([("a", v)], "name string, version string")
    assert studies.pool([c("1"), c("1")], ["version"]).count() == 2
    with pytest.raises(DataIntegrityError, match="version"):
        studies.pool([c("1"), c("2")], ["version"])
    folds = frames.random_folds(spark.range(5000), "id", 5, 1).groupBy("fold").count().collect()
    assert len(folds) == 5 and all(850 < r["count"] < 1150 for r in folds)
    assert spark.range(1).select(frames.macro_name(F.lit("net sharpe_2"))).first()[0] == "NetSharpeTwo"


def test_holding_period_and_similarity_by_hand(spark):
    rows = [("s", day(0), "a", 1.0), ("s", day(1), "a", 0.6), ("s", day(1), "b", 0.8), ("s", day(2), "b", 1.0), ("s", day(3), "a", 1.0)]
    weights = spark.createDataFrame(rows, "strategy string, session_date date, symbol string, weight double")
    assert math.isclose(studies.holding_period(weights).first().holding_period, 5 / 3)
    got = {r.lag: r.similarity for r in studies.book_similarity(weights, (1, 3)).collect()}
    assert math.isclose(got[1], (0.6 + 0.8 + 0) / 3) and math.isclose(got[3], 1.0)
    returns = spark.createDataFrame([("s", day(n), 1 + 2 * x - 3 * y) for n, (x, y) in enumerate([(0.0, 1.0), (1.0, 0.5), (2.0, 2.0), (3.0, -1.0)])], "strategy string, session_date date, ret double")
    factors = spark.createDataFrame([(day(n), x, y) for n, (x, y) in enumerate([(0.0, 1.0), (1.0, 0.5), (2.0, 2.0), (3.0, -1.0)])], "session_date date, x double, y double")
    fit = studies.joint_betas(returns, factors, ["x", "y"]).first()
    assert np.allclose([fit.alpha, fit.beta_x, fit.beta_y, fit.r_squared], [1, 2, -3, 1])


def test_mixture_filter_and_choice():
    rng = np.random.default_rng(0)
    states = np.repeat([0, 1, 0, 1], 120)
    x = np.column_stack([np.where(states, 3.0, -3.0), np.where(states, 1.0, -1.0)]) + rng.normal(size=(480, 2))
    model = stress.fit_mixture(x, 2, 1, restarts=2, steps=40)
    probabilities, evidence = stress.forward_filter(model, x)
    assert (probabilities.argmax(axis=1) == states).mean() > 0.98 and math.isclose(evidence, float(model["evidence"]), rel_tol=1e-3)
    # A row's probabilities depend on the rows up to it alone.
    assert np.allclose(stress.forward_filter(model, x[:200])[0], probabilities[:200])
    total = 0.0
    for t in range(3):
        like = np.exp(stress.log_likelihood(x[t : t + 1], model["mean"], model["var"])[0])
        p = (model["start"] if t == 0 else p @ model["move"]) * like
        total += math.log(p.sum())
        p /= p.sum()
    assert np.allclose(p, probabilities[2]) and math.isclose(total, stress.forward_filter(model, x[:3])[1], rel_tol=1e-9)
    assert stress.choose_states(x[::4], (1, 2), 1)[0] == 2


def test_block_length_grows_with_dependence():
    rng = np.random.default_rng(2)
    noise = rng.normal(size=1000)
    slow = np.zeros(1000)
    for t in range(1, 1000):
        slow[t] = 0.8 * slow[t - 1] + noise[t]
    assert stress.block_length(noise)[0] < 5 < stress.block_length(slow)[0]
    assert stress.block_length(np.zeros(50)) == (1.0, 1)


def test_predictors_find_what_is_there(spark):
    from pitwright.operators import predict

    rng = np.random.default_rng(3)
    x, z = rng.normal(size=300), rng.normal(size=300)
    rows = spark.createDataFrame([(i, float(a), float(b), float(2 * a + 0.1 * e), i % 3) for i, (a, b, e) in enumerate(zip(x, z, rng.normal(size=300)))], "k int, x double, z double, y double, fold int")
    for kind in ("ridge", "lasso", "elastic_net", "forest", "boosting"):
        r2 = predict.out_of_fold_r2(predict.out_of_fold(rows, ["x", "z"], "y", kind=kind, folds=3), "y").first()
        assert r2.n == 300 and r2.r2 > 0.8, kind
    loss = {r.feature: r.loss for r in predict.permutation_importance(rows, ["x", "z"], "y", "k", folds=3).collect()}
    assert loss["x"] > 0.9 and abs(loss["z"]) < 0.05
    moved = predict.permuted(rows, "x", "k", 1)
    assert moved.groupBy("fold").agg(F.round(F.sum("x"), 9).alias("s")).orderBy("fold").collect() == rows.groupBy("fold").agg(F.round(F.sum("x"), 9).alias("s")).orderBy("fold").collect()


def test_seeds(spark):
    import random

    from pitwright.sources import files

    draws = []
    for _ in range(2):
        files.seed_everything(7)
        draws.append((random.random(), np.random.random()))
    assert draws[0] == draws[1]
