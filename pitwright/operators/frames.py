"""Small operators on tables: columns, keys, order, folds, samples, funnels and the writing of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitwright.functions.checks import DataIntegrityError
from pitwright.sources.files import shared_dir


def uniform(seed: int, *parts: Column | str | int) -> Column:
    """A number from 0 to below 1 that depends on the seed and the parts alone: 48 bits of their SHA-256."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank from 1 over all its rows, sorted in ranges and not in one task: a row's rank is that within its range
    and the sizes of the ranges before it. The ranges are written to the shared folder, since they are drawn anew each
    time that they are computed; one row a range is summed in one task."""
    shared_dir(df.sparkSession)
    placed = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = placed.withColumn("rank", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    return inside.join(before, "__range").withColumn("rank", F.col("rank") + F.col("__before")).drop("__range", "__before")


def drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def common_keys(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Keys that all tables (of one column each) have; raises if there is none."""
    out = first.distinct()
    for o in others:
        out = out.intersect(o)
    if out.isEmpty():
        raise DataIntegrityError("the tables have no key in common")
    return out


def remap(df: DataFrame, column: str, names: dict[str, str], other: str | None = None) -> DataFrame:
    """df with the column's values renamed; values without a new name keep theirs, or become `other`."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rest = F.col(column) if other is None else F.lit(other)
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), rest))


def tail(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")


def between_sessions(df: DataFrame, calendar: DataFrame, offset: int, length: int) -> DataFrame:
    """Rows of `length` sessions from number `offset` on."""
    days = calendar.where(F.col("session_idx").between(offset, offset + length - 1)).select("session_date")
    return df.join(days, "session_date", "left_semi")


def random_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """df with fold, from 0 to below k. Each row's fold depends on its key alone, so no order of all rows is needed; folds
    are of about equal size."""
    return df.withColumn("fold", F.floor(uniform(seed, F.col(key)) * k).cast("int"))


def subsample(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group without replacement (all of a smaller one): those with the least random numbers."""
    order = W.partitionBy(*by).orderBy("__u", key)
    return df.withColumn("__u", uniform(seed, F.col(key))).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__u", "__r")


def block_resample(spark: SparkSession, n: int, blocks: int, length: int, draws: int, seed: int) -> DataFrame:
    """draw, step, src_idx: for each draw `blocks` runs of `length` neighbours that start anywhere with replacement."""
    rows = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    rows = rows.withColumn("at", F.floor(uniform(seed, F.col("draw"), F.col("block")) * (n - length + 1)))
    inside = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return inside.select("draw", (F.col("block") * length + F.col("i")).alias("step"), (F.col("at") + F.col("i")).cast("int").alias("src_idx"))


def funnel(df: DataFrame, by: list[str], stages: dict[str, Column]) -> DataFrame:
    """One row a group: n, and for each stage how many rows passed it and all before it, and their share of n."""
    passed, out = F.lit(True), [F.count("*").alias("n")]
    for name, condition in stages.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        out += [F.count_if(passed).alias(name), F.avg(passed.cast("double")).alias(f"{name}_rate")]
    return df.groupBy(*by).agg(*out)


def fixed(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", c)


def signed(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%+.{digits}f", c)


def grouped(c: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(c.cast("bigint"), 0)


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def macro_name(c: Column) -> Column:
    """Letters only, each word of the name begun with a capital; digits are spelt."""
    out = c
    for digit, word in enumerate("Zero One Two Three Four Five Six Seven Eight Nine".split()):
        out = F.replace(out, F.lit(str(digit)), F.lit(f" {word} "))
    return F.replace(F.initcap(F.trim(F.regexp_replace(out, r"[^A-Za-z]+", " "))), F.lit(" "), F.lit(""))
