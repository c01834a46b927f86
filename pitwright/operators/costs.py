"""Dated, per-leg transaction costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwright.functions.checks import DataIntegrityError


@dataclass(frozen=True)
class Segment:
    stt_buy: float
    stt_sell: float
    stamp_buy: float
    stamp_sell: float


@dataclass(frozen=True)
class Epoch:
    effective_from: str
    exchange: float
    ipft: float
    sebi: float
    gst: float
    delivery: Segment
    intraday: Segment
    delivery_rate: float = 0.0
    delivery_flat: float = 0.0
    intraday_rate: float = 0.0003
    intraday_cap: float = 20.0


DELIVERY = Segment(0.001, 0.001, 0.00015, 0.0)
INTRADAY = Segment(0.0, 0.00025, 0.00003, 0.0)
#: The published rates and the days from which they hold.
SCHEDULE = (
    Epoch("2015-01-01", 0.0000325, 0.000001, 0.000001, 0.18, DELIVERY, INTRADAY),
    Epoch("2024-04-01", 0.0000322, 0.000001, 0.000001, 0.18, DELIVERY, INTRADAY),
    Epoch("2024-10-01", 0.0000297, 0.000001, 0.000001, 0.18, DELIVERY, INTRADAY),
)
SLIPPAGE, MOST_SLIPPAGE = 0.1, 0.05
IMPACT, SIGMA = 1.0, 0.02
DEPOSITORY = 15.34
PARTS = ("brokerage", "stt", "exchange", "ipft", "sebi", "stamp", "gst", "depository")


def epoch_of(on: Column, schedule: tuple[Epoch, ...] = SCHEDULE, *, segment: str = "delivery") -> Column:
    """The rates in force on a day, as a struct; fails on a day before the first epoch. The schedule is a handful of
    rows, so it is an expression and no join."""
    rates = F.raise_error(F.concat(F.lit("no rates on "), on.cast("string")))
    out = None
    for e in sorted(schedule, key=lambda e: e.effective_from, reverse=True):
        s = e.delivery if segment == "delivery" else e.intraday
        values = {"exchange": e.exchange, "ipft": e.ipft, "sebi": e.sebi, "gst": e.gst, "stt_buy": s.stt_buy, "stt_sell": s.stt_sell, "stamp_buy": s.stamp_buy, "stamp_sell": s.stamp_sell, "delivery_rate": e.delivery_rate, "delivery_flat": e.delivery_flat, "intraday_rate": e.intraday_rate, "intraday_cap": e.intraday_cap}
        row = F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()])
        holds = on >= F.lit(e.effective_from).cast("date")
        out = F.when(holds, row) if out is None else out.when(holds, row)
    kind = ",".join(f"{k}:double" for k in values)
    return out.otherwise(rates.cast(f"struct<{kind}>"))


def charge(turnover: Column, sells: Column, rates: Column, scrips: Column, *, segment: str = "delivery", depository: float = 0.0) -> Column:
    """Statutory parts and their total for one leg, as a struct. A negative turnover fails."""
    t = F.when(turnover < 0, F.raise_error(F.lit("negative turnover")).cast("double")).otherwise(turnover)
    r = rates.getField
    if segment == "delivery":
        by_rate = t * r("delivery_rate")
        brokerage = F.when(r("delivery_flat") > 0, F.least(by_rate, r("delivery_flat"))).otherwise(by_rate)
    else:
        brokerage = F.least(t * r("intraday_rate"), r("intraday_cap"))
    exchange, ipft, sebi = t * r("exchange"), t * r("ipft"), t * r("sebi")
    parts = {
        "brokerage": brokerage,
        "stt": t * F.when(sells, r("stt_sell")).otherwise(r("stt_buy")),
        "exchange": exchange,
        "ipft": ipft,
        "sebi": sebi,
        "stamp": t * F.when(sells, r("stamp_sell")).otherwise(r("stamp_buy")),
        "gst": (brokerage + exchange + ipft + sebi) * r("gst"),
        "depository": F.when(sells, scrips * F.lit(float(depository))).otherwise(F.lit(0.0)),
    }
    total = sum(parts.values(), F.lit(0.0))
    return F.struct(*[c.alias(n) for n, c in parts.items()], total.alias("total"))


def slippage(turnover: Column, traded_value: Column) -> Column:
    share = F.least(SLIPPAGE * F.try_divide(turnover, traded_value), F.lit(MOST_SLIPPAGE))
    return turnover * F.when(traded_value > 0, share).otherwise(F.lit(MOST_SLIPPAGE))


def impact(turnover: Column, traded_value: Column, sigma: Column | None = None) -> Column:
    s = F.lit(SIGMA) if sigma is None else F.coalesce(sigma, F.lit(SIGMA))
    return F.when((traded_value > 0) & (turnover > 0), turnover * IMPACT * s * F.sqrt(F.try_divide(turnover, traded_value))).otherwise(F.lit(0.0))


def execute(legs: DataFrame, *, segment: str = "delivery", depository: float = 0.0, schedule: tuple[Epoch, ...] = SCHEDULE) -> DataFrame:
    """legs (on, turnover, side buy or sell, traded_value, scrips) with statutory (struct), slippage, impact, total."""
    missing = {"on", "turnover", "side", "traded_value", "scrips"} - set(legs.columns)
    if missing:
        raise DataIntegrityError(f"missing columns: {sorted(missing)}")
    staged = legs.withColumn("__rates", epoch_of(F.col("on"), schedule, segment=segment))
    staged = staged.withColumn("statutory", charge(F.col("turnover"), F.col("side") == "sell", F.col("__rates"), F.col("scrips"), segment=segment, depository=depository)).drop("__rates")
    value = F.coalesce("traded_value", F.lit(0.0))
    staged = staged.withColumns({"slippage": slippage(F.col("turnover"), value), "impact": impact(F.col("turnover"), value)})
    return staged.withColumn("total", F.col("statutory.total") + F.col("slippage") + F.col("impact"))


def within_circuit(fill: Column, previous: Column, band: float) -> Column:
    return F.coalesce((previous > 0) & (F.abs(F.try_divide(fill, previous) - 1) <= band + 1e-12), F.lit(False))


def audit_orders(orders: DataFrame, *, participation: float = 0.01, band: float = 0.2, min_adv: float = 0.0) -> DataFrame:
    """orders (turnover, adv, fill, previous) with violations: a list of what each order breaks."""
    rules = {
        "participation": F.coalesce(F.col("turnover") > participation * F.col("adv"), F.lit(True)),
        "circuit": ~within_circuit(F.col("fill"), F.col("previous"), band),
        "liquidity": F.coalesce(F.col("adv") < min_adv, F.lit(True)),
    }
    return orders.withColumn("violations", F.array_compact(F.array(*[F.when(broken, F.lit(n)) for n, broken in rules.items()])))
