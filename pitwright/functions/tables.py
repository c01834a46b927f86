"""Functions of users' SQL: a table function of bootstrap paths and an aggregate of deviations."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class BootstrapPath:
    """Rows of one path of stationary bootstrap, as operators.stress.bootstrap_paths draws them."""

    def eval(self, path: int, n: int, block: float, seed: int):
        def uniform(step: int, what: str) -> float:
            return int(hashlib.sha256(f"{seed}|{path}|{step}|{what}".encode()).hexdigest()[:12], 16) / float(1 << 48)

        at = 0
        for step in range(n):
            if step == 0 or uniform(step, "jump") < 1 / block:
                at = int(uniform(step, "to") * n)
            else:
                at = (at + 1) % n
            yield step, at


def _deviation(values: pd.Series) -> float:
    own = values.dropna()
    return float((own - own.median()).abs().median()) if len(own) else None


def median_deviation(column: str) -> Column:
    """Median absolute deviation from the median, as an aggregate."""
    return _aggregate()(F.col(column))


def _aggregate():
    # Made on the driver only: workers import this module without a session.
    return F.pandas_udf(_deviation, "double")


def register(spark: SparkSession) -> None:
    """Makes bootstrap_path(path, n, block, seed) and median_deviation(x) known to SQL."""
    spark.udtf.register("bootstrap_path", F.udtf(BootstrapPath, returnType="step int, src_idx int"))
    spark.udf.register("median_deviation", _aggregate())
