"""Liquidity universes with hysteresis, and as-of membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.functions.checks import require_columns


def liquidity(panel: DataFrame, calendar: DataFrame, rebalances: DataFrame, *, trailing: int) -> DataFrame:
    """rebalance_date, symbol, median_turnover, sessions_traded, window: over the last `trailing` sessions before each
    rebalance date. Rebalances fan out to their sessions (trailing rows each) before the panel is joined by session."""
    require_columns(panel, "session_date", "symbol", "turnover_inr")
    at = rebalances.join(calendar.select(F.col("session_date").alias("rebalance_date"), "session_idx"), "rebalance_date")
    first = F.greatest(F.col("session_idx") - trailing, F.lit(0))
    days = at.where("session_idx > 0").select("rebalance_date", F.col("session_idx").alias("at"), F.explode(F.sequence(first, F.col("session_idx") - 1)).alias("session_idx"))
    window = days.groupBy("rebalance_date").agg(F.count("*").alias("window"))
    seen = days.join(calendar, "session_idx").select("rebalance_date", "session_date")
    rows = panel.select("session_date", "symbol", "turnover_inr").join(seen, "session_date")
    sums = rows.groupBy("rebalance_date", "symbol").agg(F.median("turnover_inr").alias("median_turnover"), F.count("*").alias("sessions_traded"))
    return sums.join(window, "rebalance_date")


def ranked(liquid: DataFrame, *, min_listed: int, fraction: float) -> DataFrame:
    """The eligible names with rank (1 is the most liquid; equals by symbol)."""
    least = F.greatest(F.lit(min_listed * fraction), F.col("window") * fraction)
    order = W.partitionBy("rebalance_date").orderBy(F.desc("median_turnover"), "symbol")
    return liquid.where(F.col("sessions_traded") >= least).withColumn("rank", F.row_number().over(order).cast("int"))


def select(ranks: DataFrame, incumbents: DataFrame, *, size: int, entry: int, exit: int) -> DataFrame:
    """rebalance_date, symbol, rank: protected incumbents first, then newcomers inside the entry rank, then by rank."""
    held = ranks.join(incumbents.select("symbol").distinct().withColumn("held", F.lit(True)), "symbol", "left")
    held = held.withColumn("held", F.coalesce("held", F.lit(False)))
    class_ = F.when(F.col("held") & (F.col("rank") <= exit), 0).when(~F.col("held") & (F.col("rank") <= entry), 1).otherwise(2)
    place = F.row_number().over(W.partitionBy("rebalance_date").orderBy(class_, "rank"))
    return held.withColumn("place", place).where(F.col("place") <= size).select("rebalance_date", "symbol", "rank")


def history(ranks: DataFrame, *, size: int, entry: int, exit: int) -> DataFrame:
    """rebalance_date, symbol, rank over all rebalances, each protecting what the one before selected.

    The ranks of a rebalance down to where selection can reach are one list; a fold over the rebalances, tens of them,
    carries the incumbents, inside Catalyst. Raises when executed if a rebalance has fewer names than size.
    """
    deep = max(size, exit)
    lists = ranks.where(F.col("rank") <= deep + size).groupBy("rebalance_date").agg(F.sort_array(F.collect_list(F.struct("rank", "symbol"))).alias("names"))
    everything = lists.agg(F.sort_array(F.collect_list(F.struct("rebalance_date", "names"))).alias("steps"))
    none = F.array().cast("array<string>")
    picked = "array<struct<rebalance_date:date,rank:int,symbol:string>>"

    def step(state, x):
        def keyed(n):
            in_ = F.array_contains(state["held"], n["symbol"])
            return F.struct(F.when(in_ & (n["rank"] <= exit), 0).when(~in_ & (n["rank"] <= entry), 1).otherwise(2).alias("class"), n["rank"].alias("rank"), n["symbol"].alias("symbol"))

        chosen = F.slice(F.array_sort(F.transform(x["names"], keyed)), 1, size)
        whole = F.when(F.size(chosen) < size, F.raise_error(F.concat(F.lit("too few names on "), x["rebalance_date"].cast("string"))).cast(picked)).otherwise(
            F.transform(chosen, lambda n: F.struct(x["rebalance_date"].alias("rebalance_date"), n["rank"].alias("rank"), n["symbol"].alias("symbol"))).cast(picked)
        )
        return F.struct(F.transform(chosen, lambda n: n["symbol"]).alias("held"), F.concat(state["out"], whole).alias("out"))

    start = F.struct(none.alias("held"), F.array().cast(picked).alias("out"))
    folded = everything.select(F.explode(F.aggregate("steps", start, step, lambda s: s["out"])).alias("r"))
    return folded.select("r.rebalance_date", "r.symbol", "r.rank")


def membership(calendar: DataFrame, universe: DataFrame) -> DataFrame:
    """session_date, symbol: members by the last rebalance at or before each session; none before the first."""
    dates = universe.select("rebalance_date").distinct()
    marks = calendar.select("session_date", F.lit(None).cast("date").alias("rebalance_date"))
    order = W.orderBy("session_date").rowsBetween(W.unboundedPreceding, 0)
    # A rebalance date that is no session counts from the next session on.
    both = marks.unionByName(dates.select(F.col("rebalance_date").alias("session_date"), "rebalance_date")).groupBy("session_date").agg(F.max("rebalance_date").alias("rebalance_date"))
    carried = both.withColumn("rebalance_date", F.last("rebalance_date", ignorenulls=True).over(order)).where("rebalance_date is not null")
    days = carried.join(calendar.select("session_date"), "session_date", "left_semi")
    return days.join(universe.select("rebalance_date", "symbol"), "rebalance_date").select("session_date", "symbol", "rebalance_date")
