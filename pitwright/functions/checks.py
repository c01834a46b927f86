"""Errors, and checks at the entry of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataIntegrityError(ValueError):
    """The data contradict what an operator needs."""


class PointInTimeError(ValueError):
    """Something reads a row dated on or after its decision."""


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise DataIntegrityError(f"missing columns: {', '.join(missing)}")


def require_none(bad: DataFrame, message: str) -> None:
    """Raises if bad has a row; looks at five at most."""
    found = bad.take(5)
    if found:
        raise DataIntegrityError(f"{message}: {', '.join(map(str, found))}")


def known_before(df: DataFrame, day: str, as_of: Column, message: str = "a row is dated on or after its decision") -> DataFrame:
    """df, failing when a row with day >= as_of is computed; the check is part of the plan and costs no job."""
    guard = F.when(F.col(day) >= as_of, F.raise_error(F.concat(F.lit(message + ": "), F.col(day).cast("string")))).otherwise(F.col(day))
    return df.withColumn(day, guard.cast(df.schema[day].dataType))
