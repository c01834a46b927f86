"""Strategies and fitness functions of users' own, run where the data are."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Strategy(Protocol):
    def generate(self, view: pd.DataFrame) -> dict[str, float]:
        """Weights by symbol, from rows (session_date, symbol, prices) that were visible at the decision."""


def run_strategy(panel: DataFrame, calendar: DataFrame, strategy: Strategy, *, lookback: int, name: str = "user") -> DataFrame:
    """strategy, session_date (of the fill), symbol, weight of a strategy that decides after each session.

    A decision is a group: the rows of the last `lookback` sessions up to its own, and nothing later, so what the
    strategy can read is what was visible. A session's rows go to the `lookback` decisions that may see them.
    """
    fills = calendar.withColumn("fill", F.lead("session_date").over(W.orderBy("session_date"))).where("fill is not null").select(F.col("session_idx").alias("decision"), "fill")
    numbered = panel.join(calendar, "session_date")
    seen = numbered.withColumn("decision", F.explode(F.sequence(F.col("session_idx"), F.col("session_idx") + lookback - 1))).drop("session_idx")

    def decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        weights = strategy.generate(rows.drop(columns=["decision", "fill"]).sort_values(["session_date", "symbol"], ignore_index=True))
        rows = [(name, key[1], str(symbol), float(w)) for symbol, w in weights.items()]
        return pd.DataFrame(np.array(rows, object).reshape(-1, 4), columns=["strategy", "session_date", "symbol", "weight"]).astype({"weight": float})

    return seen.join(fills, "decision").groupBy("decision", "fill").applyInPandas(decide, "strategy string, session_date date, symbol string, weight double")


def _send(connection, function: Callable[[str], float | None], source: str) -> None:
    try:
        connection.send(function(source))
    except Exception:  # noqa: BLE001
        connection.send(None)
    finally:
        connection.close()


def fitness(df: DataFrame, function: Callable[[str], float | None], *, seconds: float, source_col: str = "source") -> DataFrame:
    """df with fitness: what the function makes of each source, in a process of its own that is killed after `seconds`;
    null if it was killed, failed, or gave nothing."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "fitness"], "fitness double"])
    names = [c for c in df.columns if c != "fitness"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fork = multiprocessing.get_context("fork")
        for pdf in batches:
            out = []
            for source in pdf[source_col]:
                receiver, sender = fork.Pipe(False)
                process = fork.Process(target=_send, args=(sender, function, source), daemon=True)
                process.start()
                sender.close()
                value = None
                if receiver.poll(seconds):
                    try:
                        value = receiver.recv()
                    except EOFError:
                        value = None
                process.kill()
                process.join()
                out.append(value)
            yield pdf[names].assign(fitness=pd.Series(out, dtype="float64", index=pdf.index))

    return df.select(*names).mapInPandas(run, schema)
