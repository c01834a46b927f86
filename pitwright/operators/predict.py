"""Predictors of a target from features out of fold, and what their scores rest on."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.operators.frames import uniform


def predictor(kind: str, features: list[str], target: str, *, penalty: float = 0.1, seed: int = 42) -> Pipeline:
    """An estimator of standardised features: `linear`, `ridge`, `lasso`, `elastic_net`, `forest` or `boosting`."""
    assembled = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip")
    scaled = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True)
    linear = lambda reg, mix: LinearRegression(featuresCol="__x", labelCol=target, predictionCol="predicted", regParam=reg, elasticNetParam=mix, standardization=False)
    model = {
        "linear": lambda: linear(0.0, 0.0),
        "ridge": lambda: linear(penalty, 0.0),
        "lasso": lambda: linear(penalty, 1.0),
        "elastic_net": lambda: linear(penalty, 0.5),
        "forest": lambda: RandomForestRegressor(featuresCol="__x", labelCol=target, predictionCol="predicted", numTrees=50, seed=seed),
        "boosting": lambda: GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="predicted", maxIter=30, seed=seed),
    }[kind]()
    return Pipeline(stages=[assembled, scaled, model])


def out_of_fold(rows: DataFrame, features: list[str], target: str, *, kind: str = "ridge", folds: int = 5, penalty: float = 0.1) -> DataFrame:
    """rows (fold, features, target) with predicted, by a model of all other folds, and mean_of_others. A fit for each
    fold; rows with a null feature have no prediction and are left out."""
    clean = rows.dropna(subset=[*features, target])
    out = None
    for k in range(folds):
        train, test = clean.where(F.col("fold") != k), clean.where(F.col("fold") == k)
        level = F.broadcast(train.agg(F.avg(target).alias("mean_of_others")))  # one row
        own = predictor(kind, features, target, penalty=penalty).fit(train).transform(test).drop("__raw", "__x").join(level)
        out = own if out is None else out.unionByName(own)
    return out


def out_of_fold_r2(predicted: DataFrame, target: str) -> DataFrame:
    """One row: r2 against the mean of the other folds, and the number of rows."""
    left, total = F.sum((F.col(target) - F.col("predicted")) ** 2), F.sum((F.col(target) - F.col("mean_of_others")) ** 2)
    return predicted.agg((1 - F.try_divide(left, total)).alias("r2"), F.count("*").alias("n"))


def permuted(rows: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """rows with the column's values dealt out anew within each fold, by an order of hashes."""
    drawn, own = W.partitionBy("fold").orderBy("__u", key), W.partitionBy("fold").orderBy(key)
    marked = rows.withColumn("__u", uniform(seed, F.col(key)))
    values = marked.select("fold", F.row_number().over(drawn).alias("__r"), F.col(column).alias("__v"))
    return marked.withColumn("__r", F.row_number().over(own)).drop(column).join(values, ["fold", "__r"]).withColumnRenamed("__v", column).drop("__u", "__r")


def permutation_importance(rows: DataFrame, features: list[str], target: str, key: str, *, kind: str = "linear", folds: int = 5, seed: int = 1) -> DataFrame:
    """feature, r2 and loss: what out-of-fold r2 is lost when a feature's values are permuted before fitting and scoring."""
    whole = out_of_fold_r2(out_of_fold(rows, features, target, kind=kind, folds=folds), target).select(F.col("r2").alias("whole"))
    out = None
    for f in features:
        own = out_of_fold_r2(out_of_fold(permuted(rows, f, key, seed), features, target, kind=kind, folds=folds), target).select(F.lit(f).alias("feature"), "r2")
        out = own if out is None else out.unionByName(own)
    return out.join(F.broadcast(whole)).select("feature", "r2", (F.col("whole") - F.col("r2")).alias("loss"))


def leave_one_out(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, slope (of y on x without the row) and influence (its change). Sums over all rows are one row, so no row is
    compared with another."""
    clean = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = F.broadcast(clean.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy")))
    dx, dy, n = F.col(x) - F.col("mx"), F.col(y) - F.col("my"), F.col("n")
    share = n / (n - 1)
    slope = F.try_divide(F.col("sxy") - share * dx * dy, F.col("sxx") - share * dx * dx)
    return clean.join(sums).select(key, slope.alias("slope"), (slope - F.col("sxy") / F.col("sxx")).alias("influence"))


def learning_curve(rows: DataFrame, order: str, x: str, y: str, sizes: list[int]) -> DataFrame:
    """size, slope, r_squared of fits to the first `size` rows."""
    placed = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__r", F.row_number().over(W.orderBy(order)))
    each = placed.where(F.col("__r") <= max(sizes)).withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.col("__r") <= F.col("size"))
    return each.groupBy("size").agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r_squared"))


def trimmed(rows: DataFrame, value: str, share: float) -> DataFrame:
    """One row: the mean of the values between the quantiles `share` and 1 - `share`, and their number."""
    cuts = F.broadcast(rows.agg(F.percentile(value, share).alias("lo"), F.percentile(value, 1 - share).alias("hi")))
    return rows.join(cuts).where(F.col(value).between(F.col("lo"), F.col("hi"))).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def permutation_test(rows: DataFrame, key: str, x: str, y: str, *, draws: int, seed: int) -> DataFrame:
    """One row: r_squared of y on x, and p_value, the share of draws, the real one counted, in which the values of x, dealt
    out anew, fit as well. All draws are one job."""
    clean = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    many = clean.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    own = W.partitionBy("draw")
    placed = many.withColumns({"a": F.row_number().over(own.orderBy("k")), "b": F.row_number().over(own.orderBy(uniform(seed, F.col("draw"), F.col("k")), "k"))})
    drawn = placed.select("draw", F.col("a").alias("r"), "y").join(placed.select("draw", F.col("b").alias("r"), "x"), ["draw", "r"])
    real = F.broadcast(clean.agg(F.regr_r2("y", "x").alias("r_squared")))  # one row
    fits = drawn.groupBy("draw").agg(F.regr_r2("y", "x").alias("own")).join(real)
    return fits.groupBy("r_squared").agg(((F.count_if(F.col("own") >= F.col("r_squared")) + 1) / F.lit(draws + 1.0)).alias("p_value"))
