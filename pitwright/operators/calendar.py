"""Trading-calendar algebra on a table of sessions with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.functions.checks import DataIntegrityError, require_none


def build(days: DataFrame, column: str = "session_date") -> DataFrame:
    """session_date, session_idx (from 0). A calendar has a row a day, so one task orders it."""
    plain = days.select(F.col(column).cast("date").alias("session_date")).where("session_date is not null").distinct()
    return plain.withColumn("session_idx", (F.row_number().over(W.orderBy("session_date")) - 1).cast("int"))


def is_session(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """days (day) with trades."""
    marks = calendar.select(F.col("session_date").alias("day"), F.lit(True).alias("trades"))
    return days.join(marks, "day", "left").withColumn("trades", F.coalesce("trades", F.lit(False)))


def require_sessions(days: DataFrame, calendar: DataFrame) -> DataFrame:
    require_none(days.join(calendar, F.col("day") == F.col("session_date"), "left_anti").select("day"), "no sessions")
    return days


def neighbours(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """days (day) with previous (last session before), at_or_before, at_or_after and next (first session after).

    Sessions and days are put in one order and the nearest session is carried along, so no pair of them is formed.
    """
    rows = days.select("day").distinct().withColumn("session_date", F.lit(None).cast("date")).unionByName(calendar.select(F.col("session_date").alias("day"), "session_date"))
    rows = rows.groupBy("day").agg(F.max("session_date").alias("session_date"))
    order = W.orderBy("day")
    past, future = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    last, first = F.last("session_date", ignorenulls=True), F.first("session_date", ignorenulls=True)
    out = rows.select("day", last.over(past).alias("previous"), F.coalesce("session_date", last.over(past)).alias("at_or_before"), F.coalesce("session_date", first.over(future)).alias("at_or_after"), first.over(future).alias("next"))
    return days.join(out, "day")


def shift(days: DataFrame, calendar: DataFrame, n: int, *, strict: bool = True) -> DataFrame:
    """days (day) with shifted, the session n later (earlier if negative). A day that is no session, or whose shifted
    session is out of range, fails when it is computed; not strict: it has null."""
    here = calendar.select(F.col("session_date").alias("day"), (F.col("session_idx") + n).alias("to"))
    there = calendar.select(F.col("session_date").alias("shifted"), F.col("session_idx").alias("to"))
    out = days.join(here, "day", "left").join(there, "to", "left")
    if strict:
        why = F.when(F.col("to").isNull(), F.concat(F.col("day").cast("string"), F.lit(" is no session"))).otherwise(F.concat(F.col("day").cast("string"), F.lit(f" has no session {n} from it")))
        out = out.withColumn("shifted", F.when(F.col("shifted").isNull(), F.raise_error(why).cast("date")).otherwise(F.col("shifted")))
    return out.drop("to")


def between(calendar: DataFrame, start: str, end: str) -> DataFrame:
    if start > end:
        raise DataIntegrityError("start is after end")
    return calendar.where(F.col("session_date").between(start, end))


def rebalance_dates(calendar: DataFrame, every: str = "quarter") -> DataFrame:
    """First session of each month or quarter."""
    period = F.trunc("session_date", every)
    return calendar.groupBy(period.alias("period")).agg(F.min("session_date").alias("rebalance_date")).select("rebalance_date")


def weekdays(start: str, end: str, holidays: DataFrame) -> DataFrame:
    """Weekdays from start to end that are no holidays (holiday)."""
    spark = holidays.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")).where(F.weekday("day") < 5)
    return days.join(holidays.select(F.col("holiday").alias("day")), "day", "left_anti")


def missing_sessions(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions of the calendar, from the panel's first day to its last, that the panel lacks."""
    span = panel.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b")).first()
    if span["a"] is None:
        return calendar.select("session_date")
    inside = calendar.where(F.col("session_date").between(span["a"], span["b"]))
    return inside.join(panel.select("session_date").distinct(), "session_date", "left_anti").select("session_date")


def require_contiguous(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    require_none(missing_sessions(panel, calendar), "the panel lacks sessions")
    return panel


def every_nth(calendar: DataFrame, n: int) -> DataFrame:
    return calendar.where(F.col("session_idx") % n == 0)
