"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a kernel takes at once, whatever the size of the Arrow batch around them.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one under /tmp if all runs on
    this machine, else an error: executors elsewhere would lose what they write there."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder; a lost executor takes nothing of it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of one or two numbers up to which a table is broadcast.
SMALL = 500_000


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """df, a table of one or two numbers a row that is written already: broadcast where it has SMALL rows at most, which
    are counted first; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL else df


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch of about SLICE_BYTES of that column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    kernel: Callable[[list[str]], Sequence[Sequence]],
    fields: Sequence[tuple[str, str]],
    *,
    text_col: str = "text",
    keep: Sequence[str] | None = None,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """The columns keep (None: all) of df and what the kernel makes of the texts, a list for each field (name, type).

    after: called when a task ends, to release what the kernel keeps in its worker.
    A null text counts as empty. A new field takes the place of an input column of the same name.
    """
    require_columns(df, text_col)
    names = {n for n, _ in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    inner = text_col if text_col in keep else fresh(df, "text")
    added = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = T.StructType([df.schema[c] for c in keep] + list(added))
    plain = df.select(*[F.col(f"`{c}`") for c in keep], *([] if text_col in keep else [F.col(f"`{text_col}`").alias(inner)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        try:
            for batch in batches:
                for part in slices(batch, inner):
                    made = kernel(pc.fill_null(part.column(inner), "").to_pylist())
                    columns = [part.column(c).cast(out.field(c).type) for c in keep]
                    columns += [pa.array(v, type=out.field(len(keep) + i).type) for i, v in enumerate(made)]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)
        finally:
            if after is not None:
                after()

    return plain.mapInArrow(run, schema)
