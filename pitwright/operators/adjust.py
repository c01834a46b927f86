"""Corporate actions: detection, reconciliation, back-adjustment, and the register of flagged points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.functions.checks import require_columns
from pitwright.operators.features import by_symbol

BAND = 1.05
TOLERANCE = 0.10
SNAP = 0.05
DROP = 0.65


def with_prior(panel: DataFrame, calendar: DataFrame, price: str = "close") -> DataFrame:
    """panel with session_idx, prior (price of the symbol's quotation before) and adjacent (it was the session before)."""
    numbered = panel.join(calendar, "session_date")
    return numbered.withColumns({"prior": F.lag(price).over(by_symbol()), "adjacent": F.col("session_idx") - F.lag("session_idx").over(by_symbol()) == 1})


def detect(panel: DataFrame, calendar: DataFrame, *, band: float = BAND) -> DataFrame:
    """symbol, ex_date, factor: prior close over the stated previous close, outside the band, on adjacent sessions."""
    require_columns(panel, "session_date", "symbol", "close", "prev_close")
    ratio = F.try_divide("prior", "prev_close")
    found = with_prior(panel, calendar).where("prev_close > 0 and adjacent").withColumn("factor", ratio)
    return found.where((F.col("factor") > band) | (F.col("factor") < 1 / band)).select("symbol", F.col("session_date").alias("ex_date"), "factor")


def reconcile(declared: DataFrame, panel: DataFrame, calendar: DataFrame, *, tolerance: float = TOLERANCE) -> DataFrame:
    """declared (symbol, ex_date, factor) with observed (close of the session before over the open) and agrees.
    Events without either price are left out."""
    opens = panel.join(calendar, "session_date").select("symbol", F.col("session_date").alias("ex_date"), "session_idx", F.col("open").alias("ex_open"))
    closes = panel.join(calendar, "session_date").select("symbol", (F.col("session_idx") + 1).alias("session_idx"), F.col("close").alias("prior_close"))
    both = declared.join(opens, ["symbol", "ex_date"]).join(closes, ["symbol", "session_idx"]).where("ex_open > 0 and prior_close > 0")
    both = both.withColumn("observed", F.col("prior_close") / F.col("ex_open"))
    return both.select("symbol", "ex_date", "factor", "observed", (F.abs(F.col("observed") / F.col("factor") - 1) <= tolerance).alias("agrees"))


def conventional_factors(most: int = 10) -> list[float]:
    """Ratios a:b of small whole numbers that splits and bonus issues use, without 1."""
    return sorted({a / b for a in range(1, most + 1) for b in range(1, 6) if a != b and a / b >= 1})


def snap(events: DataFrame, *, column: str = "observed", within: float = SNAP, factors: list[float] | None = None) -> DataFrame:
    """events with snapped: the nearest conventional factor, or its inverse, if within a share of it; else null."""
    near = [*(factors or conventional_factors())]
    near += [1 / f for f in near]
    c = F.col(column)
    best = F.array_min(F.array(*[F.struct(F.abs(c - f) / f, F.lit(f).alias("f")) for f in near]))
    return events.withColumn("__best", best).withColumn("snapped", F.when(F.col("__best").getField("col1") <= within, F.col("__best.f"))).drop("__best")


def resolve(disputed: DataFrame, *, within: float = SNAP) -> DataFrame:
    """disputed with decision (snapped, no_adjustment, unresolved) and final_factor (null if unresolved)."""
    out = snap(disputed, within=within)
    none = F.abs(F.col("observed") - 1) <= within
    decision = F.when(none, "no_adjustment").when(F.col("snapped").isNotNull(), "snapped").otherwise("unresolved")
    return out.withColumn("decision", decision).withColumn("final_factor", F.when(none, 1.0).otherwise(F.col("snapped")))


def back_adjust(panel: DataFrame, events: DataFrame) -> DataFrame:
    """panel with divisor (product of the factors of later ex-dates) and adjusted prices and volume."""
    factors = events.groupBy("symbol", "ex_date").agg(F.product("factor").alias("f"))
    rows = panel.select("symbol", "session_date", F.lit(1.0).alias("f"), F.lit(True).alias("quoted")).unionByName(factors.select("symbol", F.date_sub("ex_date", 0).alias("session_date"), "f", F.lit(False).alias("quoted")))
    later = W.partitionBy("symbol").orderBy(F.desc("session_date"), F.desc("quoted")).rowsBetween(W.unboundedPreceding, 0)
    divisors = rows.withColumn("divisor", F.product("f").over(later)).where("quoted").select("symbol", "session_date", "divisor")
    out = panel.join(divisors, ["symbol", "session_date"])
    return out.withColumns({**{f"adj_{c}": F.col(c) / F.col("divisor") for c in ("open", "high", "low", "close")}, "adj_volume": F.col("volume") * F.col("divisor")})


def unexplained_moves(panel: DataFrame, calendar: DataFrame, declared: DataFrame, *, below: float = DROP) -> DataFrame:
    """symbol, session_date, ratio: adjusted closes that fell below a share of the session before, and no event says why."""
    moved = with_prior(panel, calendar, "adj_close").where("adjacent and prior > 0").withColumn("ratio", F.col("adj_close") / F.col("prior")).where(F.col("ratio") < below)
    known = declared.select("symbol", F.col("ex_date").alias("session_date"))
    return moved.join(known, ["symbol", "session_date"], "left_anti").select("symbol", "session_date", "ratio")


def register(curated: DataFrame, unresolved: DataFrame) -> DataFrame:
    """symbol, start_date, end_date, reason, detail of all flagged points, without repeats."""
    points = unresolved.select("symbol", F.col("ex_date").alias("start_date"), F.col("ex_date").alias("end_date"), F.lit("unresolved_factor").alias("reason"), F.col("observed").cast("string").alias("detail"))
    return curated.select(points.columns).unionByName(points).distinct()


def flagged(panel: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows of the panel inside a flagged interval, once for each reason. Joined by symbol; the days are the rest."""
    f = flags.select("symbol", "start_date", "end_date", "reason")
    return panel.join(f, "symbol").where(F.col("session_date").between(F.col("start_date"), F.col("end_date"))).drop("start_date", "end_date")


def flagged_points(points: DataFrame, flags: DataFrame) -> DataFrame:
    """points (symbol, session_date) with flagged and reasons, the sorted distinct reasons of the intervals around each.
    An interval is inclusive. Points of symbols without an interval are joined with nothing."""
    f = flags.select(F.col("symbol").alias("s"), "start_date", "end_date", "reason")
    hit = points.join(f, (F.col("symbol") == F.col("s")) & F.col("session_date").between(F.col("start_date"), F.col("end_date")), "left")
    return hit.groupBy("symbol", "session_date").agg(F.array_sort(F.collect_set("reason")).alias("reasons")).withColumn("flagged", F.size("reasons") > 0)


def without_flagged(panel: DataFrame, flags: DataFrame) -> DataFrame:
    f = flags.select(F.col("symbol").alias("s"), "start_date", "end_date")
    return panel.join(f, (F.col("symbol") == F.col("s")) & F.col("session_date").between(F.col("start_date"), F.col("end_date")), "left_anti")


def cross_check(ours: DataFrame, theirs: DataFrame, *, tolerance: float = 0.005, worst: int = 3, report: int = 15, ceiling: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row: compared, mismatched, rate; the worst differences, some for each symbol and some in all). ceiling: a rate
    above it fails when it is computed."""
    both = ours.select("session_date", "symbol", F.col("close").alias("a")).join(theirs.select("session_date", "symbol", F.col("close").alias("b")), ["session_date", "symbol"]).where("b > 0")
    both = both.withColumn("difference", F.abs(F.col("a") / F.col("b") - 1))
    rate = both.agg(F.count("*").alias("compared"), F.count_if(F.col("difference") > tolerance).alias("mismatched")).withColumn("rate", F.try_divide("mismatched", "compared"))
    if ceiling is not None:
        rate = rate.withColumn("rate", F.when(F.col("rate") > ceiling, F.raise_error(F.concat(F.lit("share of differences: "), F.col("rate").cast("string"))).cast("double")).otherwise(F.col("rate")))
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("difference"), "session_date"))
    return rate, both.withColumn("r", place).where(F.col("r") <= worst).drop("r").orderBy(F.desc("difference"), "symbol", "session_date").limit(report)
