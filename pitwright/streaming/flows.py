"""Streams of events as panels: windows with watermarks, and a running book of each symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_flow(events: DataFrame, *, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, symbol, value, n of each window; rows later than `late` are left out, and a window is final once
    the watermark has passed it. Works on a batch as well."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("at", late) if events.isStreaming else stamped
    sums = stamped.groupBy(F.window("at", window), F.col("event_type").alias("symbol")).agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    return sums.select(F.col("window.start").alias("window_start"), "symbol", "value", "n")


def running_totals(events: DataFrame, *, key: str = "user_id") -> DataFrame:
    """key, n, value so far of each key that a micro-batch touches; the state of a key is two numbers."""

    def update(at: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, value = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, value = n + len(pdf), value + float(pdf["value"].fillna(0).sum())
        state.update((n, value))
        yield pd.DataFrame({key: [at[0]], "n": [n], "value": [value]})

    kind = f"{key} bigint, n bigint, value double"
    return events.groupBy(key).applyInPandasWithState(update, kind, "n bigint, value double", "update", GroupStateTimeout.NoTimeout)
