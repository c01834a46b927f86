"""State that goes on from one micro-batch to the next: hash chains, filtered probabilities, books; and late rows."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitwright.sources.files import shared_dir


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream gives for what has arrived by now, written to the shared folder batch by batch and read from
    there. Each batch replaces its own folder, so a batch that is run again adds nothing. mode: `complete` keeps the last
    batch only."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema, last = stream.schema, []

    def write(batch: DataFrame, number: int) -> None:
        last[:] = [number]
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{at}/rows").parquet(f"{at}/rows/batch={last[0]}" if mode == "complete" else f"{at}/rows")
    return rows.select(*schema.names)


def hash_chain(events: DataFrame, *, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """key, order, seq, hash: each event of a key chained to the one before it, sha256 of the hash before, a bar and the
    order value. The state of a key is its last hash and number; events of a batch are chained in order."""

    def chain(at: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, last = state.get if state.exists else (0, "")
        out = []
        for value in sorted(v for pdf in batches for v in pdf[order].tolist()):
            last = hashlib.sha256(f"{last}|{value}".encode()).hexdigest()
            out.append((at[0], value, seq, last))
            seq += 1
        state.update((seq, last))
        yield pd.DataFrame(out, columns=[key, order, "seq", "hash"])

    return events.groupBy(key).applyInPandasWithState(chain, f"{key} bigint, {order} bigint, seq bigint, hash string", "seq bigint, hash string", "append", GroupStateTimeout.NoTimeout)


def forward_filter(events: DataFrame, means: tuple[float, float], sd: float, stay: float, *, key: str = "user_id", order: str = "event_id", value: str = "value") -> DataFrame:
    """key, order, p: the probability of the second of two states after each event, given all events of the key up to it;
    a state stays with a probability and gives normal values around its mean. The state of a key is one number."""

    def step(at: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (p,) = state.get if state.exists else (0.5,)
        rows = pd.concat([*batches]).dropna(subset=[value]).sort_values(order)
        out = []
        for n, x in zip(rows[order].tolist(), rows[value].tolist()):
            ahead = p * stay + (1 - p) * (1 - stay)
            odds = math.exp(((x - means[0]) ** 2 - (x - means[1]) ** 2) / (2 * sd * sd))
            p = ahead * odds / (ahead * odds + 1 - ahead)
            out.append((at[0], n, p))
        state.update((p,))
        yield pd.DataFrame(out, columns=[key, order, "p"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} bigint, {order} bigint, p double", "p double", "append", GroupStateTimeout.NoTimeout)


def split_late(batch: DataFrame, seen: DataFrame, *, late: str = "1 hour", stamp: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of a batch: late ones are older than the latest row of earlier batches by more than
    `late`. seen: the earlier batches' rows, or their maximum."""
    bound = F.broadcast(seen.agg((F.max(stamp) - F.expr(f"interval {late}")).alias("__bound")))  # one row
    marked = batch.join(bound).withColumn("__late", F.coalesce(F.col(stamp) < F.col("__bound"), F.lit(False))).drop("__bound")
    return marked.where("not __late").drop("__late"), marked.where("__late").drop("__late")


def book(fills: DataFrame, *, key: str = "user_id", order: str = "event_id", ret: str = "ret", weight: str = "weight", initial: float = 1.0) -> DataFrame:
    """key, order, equity, held: equity compounded by the weight held and the return of each session; the weight of a
    session is held into the next one. A key that has nothing left gives no more rows."""

    def run(at: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        equity, held = state.get if state.exists else (initial, 0.0)
        rows = pd.concat([*batches]).sort_values(order)
        out = []
        for n, x, w in zip(rows[order].tolist(), rows[ret].tolist(), rows[weight].tolist()):
            if equity <= 0:
                break
            equity *= 1 + held * x
            held = w
            out.append((at[0], n, equity, held))
        state.update((equity, held))
        yield pd.DataFrame(out, columns=[key, order, "equity", "held"])

    return fills.groupBy(key).applyInPandasWithState(run, f"{key} bigint, {order} bigint, equity double, held double", "equity double, held double", "append", GroupStateTimeout.NoTimeout)
