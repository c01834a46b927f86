"""Panels made of the driver's tables, and panels read from files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwright.functions.checks import DataIntegrityError, require_none
from pitwright.sources.files import shared_dir, state_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aggregate_prices(spark: SparkSession, sf_dir: str, every: str = "week") -> DataFrame:
    """symbol (brand), session_date, open, high, low, close, volume, turnover_inr: unit prices of line items by day or
    week of shipping. The part table's two columns are the smaller side; Spark decides by size whether to broadcast."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    day = F.to_date("l_shipdate") if every == "day" else F.to_date(F.date_trunc(every, "l_shipdate"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", price.alias("price"))
    return (
        items.join(parts, "l_partkey")
        .groupBy("symbol", day.alias("session_date"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("turnover_inr"),
        )
    )


#: Panels that were written by this application, by what they were made of.
_WRITTEN: dict[tuple, str] = {}


def price_panel(spark: SparkSession, sf_dir: str, every: str = "week") -> DataFrame:
    """aggregate_prices(), written once for an application and read from there by every use, so that a query that uses it
    several times scans the line items once. It is written again where the tables have changed."""
    key = (spark.sparkContext.applicationId, every, *[state_of(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")])
    if key not in _WRITTEN:
        at = f"{shared_dir(spark)}/panel-{every}-{uuid.uuid4().hex}"
        aggregate_prices(spark, sf_dir, every).write.parquet(at)
        _WRITTEN[key] = at
    return spark.read.parquet(_WRITTEN[key])


def event_panel(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """symbol (event type or user), session_date, value (sum), n."""
    rows = table(spark, sf_dir, "events").select(F.col(key).cast("string").alias("symbol"), F.to_date("ts").alias("session_date"), "value")
    return rows.groupBy("symbol", "session_date").agg(F.sum("value").alias("value"), F.count("*").alias("n"))


def net_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_date, net: purchases less errors of a day."""
    v = F.coalesce("value", F.lit(0.0))
    signed = F.when(F.col("event_type") == "purchase", v).when(F.col("event_type") == "error", -v).otherwise(F.lit(0.0))
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("session_date")).agg(F.sum(signed).alias("net"))


def read_sessions(spark: SparkSession, paths: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """One Parquet file for each session (session date to path), in one scan; raises naming the first five missing."""
    missing = []
    for day, path in sorted(paths.items()):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            missing.append(day)
    if missing:
        raise DataIntegrityError(f"{len(missing)} sessions are missing: {', '.join(missing[:5])}")
    df = spark.read.parquet(*[p for _, p in sorted(paths.items())])
    return df.select(*columns) if columns else df


#: Older headers and today's names for them, and the columns that a price file must have. The older turnover is in rupees,
#: today's in lakhs, so they have different names. Fixed values of the file format.
LEGACY_HEADERS = {"OPEN": "OPEN_PRICE", "HIGH": "HIGH_PRICE", "LOW": "LOW_PRICE", "CLOSE": "CLOSE_PRICE", "PREVCLOSE": "PREV_CLOSE", "TOTTRDQTY": "TTL_TRD_QNTY", "TOTTRDVAL": "TURNOVER_INR", "TIMESTAMP": "DATE1"}
PRICE_COLUMNS = ("SYMBOL", "SERIES", "PREV_CLOSE", "OPEN_PRICE", "HIGH_PRICE", "LOW_PRICE", "CLOSE_PRICE", "TTL_TRD_QNTY")
DATE_FORMATS = ("dd-MMM-yyyy", "dd-MMMM-yyyy", "yyyy-MM-dd")
LAKH = 100_000.0


def stated_date(stamp: Column) -> Column:
    """The date of a file's own stamp, in any of DATE_FORMATS; null if in none."""
    # Spark reads month names as they are written: first letter large.
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.initcap(F.lower(F.trim(stamp))) if "MMM" in f else F.trim(stamp), F.lit(f))) for f in DATE_FORMATS])


def csv_cells(line: Column) -> Column:
    """Cells of a line, split at commas outside quotes."""
    return F.split(line, r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")


def parse_prices(lines: DataFrame, session_date: str, name: str = "the price file") -> DataFrame:
    """Equity rows of a price file as a panel of one session. lines: (number, value), the first is the header, whose
    names are stripped and brought to today's.

    Raises if the file is empty or a web page, columns are missing, no equity row is there, the equity rows do not all
    bear one date or that is not the session's, or a close is not positive. Prices and turnover are in rupees.
    """
    first = lines.where("number = 0").first()
    header = (first["value"] if first else None) or ""
    if not header.strip():
        raise DataIntegrityError(f"{name} is empty")
    if "<html" in header.lower() or header.lower().lstrip().startswith("<!doctype"):
        raise DataIntegrityError(f"{name} is a web page")
    names = [LEGACY_HEADERS.get(c.strip().upper(), c.strip().upper()) for c in header.split(",")]
    rupees = "TURNOVER_INR" in names
    turnover = "TURNOVER_INR" if rupees else "TURNOVER_LACS"
    if missing := [c for c in (*PRICE_COLUMNS, turnover, "DATE1") if c not in names]:
        raise DataIntegrityError(f"{name}: missing columns {', '.join(missing)}")
    cells = csv_cells(F.col("value"))
    cell = lambda c: F.trim(F.replace(F.get(cells, F.lit(names.index(c))), F.lit('"'), F.lit("")))
    number = lambda c: F.replace(cell(c), F.lit(","), F.lit("")).try_cast("double")
    equity = lines.where("number > 0").where(cell("SERIES") == "EQ").withColumn("stamp", F.nullif(cell("DATE1"), F.lit("")))
    out = equity.select(
        F.lit(session_date).cast("date").alias("session_date"),
        cell("SYMBOL").alias("symbol"),
        *[number(c).alias(n) for c, n in zip(PRICE_COLUMNS[2:], ("prev_close", "open", "high", "low", "close", "volume"))],
        (number(turnover) * (1.0 if rupees else LAKH)).alias("turnover_inr"),
        "stamp",
    )
    seen = out.agg(F.count("*").alias("n"), F.count_if((F.col("close") <= 0) | F.col("close").isNull()).alias("bad"), F.count_distinct("stamp").alias("stamps"), F.min(stated_date(F.col("stamp"))).alias("stated"), F.min("stamp").alias("stamp")).first()
    if not seen["n"]:
        raise DataIntegrityError(f"{name} has no equity rows")
    if seen["stamps"] != 1:
        raise DataIntegrityError(f"{name} bears {seen['stamps']} dates")
    if seen["stated"] is None:
        raise DataIntegrityError(f"{name} bears the date {seen['stamp']!r}, which can't be read")
    if str(seen["stated"]) != session_date:
        raise DataIntegrityError(f"{name} is of {seen['stated']}, not of {session_date}")
    if seen["bad"]:
        raise DataIntegrityError(f"{name}: {seen['bad']} rows without a positive close")
    return out.drop("stamp")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, value) of the lines of one file."""
    whole = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("lines"))
    return whole.select(F.posexplode("lines").alias("number", "value"))


def read_price_csv(spark: SparkSession, path: str, session_date: str) -> DataFrame:
    return parse_prices(numbered_lines(spark, path), session_date, path)


def session_path(root: str, session_date: Column | str, kind: str = "prices") -> Column:
    """Where the file of a session lies: a Hive partition."""
    day = F.lit(session_date) if isinstance(session_date, str) else session_date
    return F.concat(F.lit(f"{root}/{kind}/session_date="), F.date_format(day, "yyyy-MM-dd"))


PARTICIPANTS = ("Client", "DII", "FII", "Pro")


def parse_participants(lines: DataFrame, session_date: str) -> DataFrame:
    """session_date, category, measure, contracts of a participant file: lines (number, value), the first a title and
    the second the header. Raises if a category or TOTAL is missing or a cell is blank."""
    header = lines.where("number = 1").first()
    if header is None:
        raise DataIntegrityError("the participant file has no header")
    names = [n.strip() for n in header["value"].split(",")]
    cells = csv_cells(F.col("value"))
    rows = lines.where("number > 1 and trim(value) != ''").select(F.trim(F.get(cells, F.lit(0))).alias("category"), *[F.trim(F.regexp_replace(F.get(cells, F.lit(i)), '[",]', "")).alias(n) for i, n in enumerate(names) if i])
    found = {r["category"] for r in rows.select("category").collect()}
    if missing := [c for c in (*PARTICIPANTS, "TOTAL") if c not in found]:
        raise DataIntegrityError(f"missing categories: {', '.join(missing)}")
    long = rows.where("category != 'TOTAL'").unpivot(["category"], names[1:], "measure", "cell")
    require_none(long.where("cell is null or cell = ''"), "blank cells")
    return long.select(F.to_date(F.lit(session_date)).alias("session_date"), "category", "measure", F.col("cell").cast("bigint").alias("contracts"))


def stitch(first: DataFrame, second: DataFrame, on: str = "session_date") -> DataFrame:
    """Two abutting series as one; raises where they overlap. Of a day's several rows in one file the least stays."""
    require_none(first.select(on).intersect(second.select(on)), "days of both files")
    both = first.unionByName(second)
    rest = [c for c in both.columns if c != on]
    return both.groupBy(on).agg(F.min(F.struct(*rest)).alias("row")).select(*[F.col(on) if c == on else F.col("row").getField(c).alias(c) for c in both.columns])
