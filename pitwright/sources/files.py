"""Sinks and sidecars: write-once files with a record of where they come from, manifests, hash chains."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import logging
import platform
import random
import subprocess
import time
import uuid
from contextlib import contextmanager
from typing import Any

import numpy as np
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwright.functions.checks import DataIntegrityError


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one under /tmp if all runs on
    this machine, else an error: executors elsewhere would lose what they write there."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise DataIntegrityError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def state_of(spark: SparkSession, path: str) -> str:
    """A text that changes when the files under a path do."""
    fs, at = _fs(spark, path)
    summary = fs.getContentSummary(at)
    return f"{path}:{fs.getFileStatus(at).getModificationTime()}:{summary.getLength()}:{summary.getFileCount()}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return bool(fs.exists(at))


def read_text(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise DataIntegrityError(f"{path} is missing")
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes under another name and renames, so a reader sees the old file or the new one."""
    fs, at = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    context.rename(draft, at, options)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise DataIntegrityError(f"{path} is missing")
    return spark.read.parquet(path)


def digest(spark: SparkSession, path: str) -> str:
    """One hash of all part files, in order of their own hashes; the files are hashed where they are read."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.sha2("content", 256).alias("h"))
    return hashlib.sha256("".join(sorted(r["h"] for r in parts.collect())).encode()).hexdigest()


def write_once(df: DataFrame, path: str, source: str, **extra: Any) -> dict:
    """Parquet that must not exist yet, and path.meta.json with source, time, rows and hash."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(path)
    meta = {"source": source, "written_at": dt.datetime.now(dt.UTC).isoformat(), "rows": spark.read.parquet(path).count(), "sha256": digest(spark, path), **extra}
    write_text(spark, f"{path}.meta.json", json.dumps(meta, sort_keys=True))
    return meta


def verify(spark: SparkSession, path: str) -> dict:
    """The record of a written-once path; raises if its files are no longer what was written."""
    meta = json.loads(read_text(spark, f"{path}.meta.json"))
    if digest(spark, path) != meta["sha256"]:
        raise DataIntegrityError(f"{path} has changed since it was written")
    return meta


def write_derived(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_markdown(df: DataFrame, path: str, *, most: int = 10_000) -> None:
    """A Markdown table, for small tables that people read; raises beyond `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise DataIntegrityError(f"more than {most} rows are no sheet to read")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in row] for row in rows]]
    write_text(df.sparkSession, path, "".join(f"| {' | '.join(line)} |\n" for line in lines))


def write_sheet(df: DataFrame, path: str) -> None:
    """One CSV file; for small tables that people read."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def revision(folder: str = ".") -> str | None:
    """The commit that a checkout is at; null outside of one."""
    try:
        found = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=False)
    except OSError:
        return None
    return found.stdout.strip() or None


@contextmanager
def manifest(spark: SparkSession, path: str, *, config: dict | None = None, paths: dict[str, str] | None = None, **inputs: Any):
    """A record of one execution, written also when it fails; the caller may add to it. config: recorded by its hash;
    paths: named Parquet inputs, recorded by the hashes of their files."""
    record = {
        "run": uuid.uuid4().hex,
        "revision": revision(),
        "application": spark.sparkContext.applicationId,
        "versions": {"spark": spark.version, "python": platform.python_version(), "numpy": np.__version__},
        "config_sha256": canonical_hash(config) if config is not None else None,
        "input_sha256": {n: digest(spark, p) for n, p in (paths or {}).items()},
        "started_at": dt.datetime.now(dt.UTC).isoformat(),
        "inputs": inputs,
        "error": None,
    }
    start = time.monotonic()
    try:
        yield record
    except BaseException as e:
        record["error"] = f"{type(e).__name__}: {e}"
        raise
    finally:
        record["seconds"] = round(time.monotonic() - start, 3)
        write_text(spark, path, json.dumps(record, sort_keys=True, default=str))


def link(seq: int, name: str, outcome: str, before: str) -> str:
    return hashlib.sha256("|".join([str(seq), name, outcome, before]).encode()).hexdigest()


def append_trial(spark: SparkSession, path: str, name: str, outcome: str) -> dict:
    """Adds a line to a hash chain; one writer at a time, on the driver."""
    lines = [json.loads(x) for x in read_text(spark, path).splitlines() if x] if exists(spark, path) else []
    before = lines[-1]["hash"] if lines else ""
    line = {"seq": len(lines), "name": name, "outcome": outcome, "prev_hash": before, "hash": link(len(lines), name, outcome, before)}
    write_text(spark, path, "\n".join(json.dumps(x, sort_keys=True) for x in [*lines, line]) + "\n")
    return line


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    kind = "seq int, name string, outcome string, prev_hash string, hash string"
    return spark.read.text(path).where("trim(value) != ''").select(F.from_json("value", kind).alias("r")).select("r.*")


def read_records(spark: SparkSession, pattern: str, kind: str) -> DataFrame:
    """JSON records of many files, one object a file, with the file they come from."""
    return spark.read.schema(kind).option("multiLine", True).json(pattern).withColumn("file", F.input_file_name())


#: How a timeline may write its days; a month or a year alone stands for its first day.
EVENT_DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy-MM", "yyyy")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A checked timeline: announced_date, effective_date, category, title, description, source_url."""
    kind = "announced_date string, effective_date string, category string, title string, description string, source_url string"
    rows = spark.read.schema(kind).option("header", True).csv(path)
    day = lambda c: F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in EVENT_DATES])
    return validate_events(rows.withColumns({c: day(c) for c in ("announced_date", "effective_date")})).orderBy("announced_date", "title")


def validate_events(rows: DataFrame) -> DataFrame:
    """rows, or an error that counts what is wrong with them; one pass."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = {
        "rows": F.count("*"),
        "blank title, category or description": F.count_if(blank("title") | blank("category") | blank("description")),
        "no announced date": F.count_if(F.col("announced_date").isNull()),
        "effective before announced": F.count_if(F.col("effective_date") < F.col("announced_date")),
        "source is no https address": F.count_if(~F.coalesce(F.startswith("source_url", F.lit("https://")), F.lit(False))),
        "repeated titles": F.count("title") - F.count_distinct("title"),
    }
    seen = rows.agg(*[c.alias(n) for n, c in checks.items()]).first().asDict()
    if not seen.pop("rows"):
        raise DataIntegrityError("the timeline is empty")
    if wrong := {n: v for n, v in seen.items() if v}:
        raise DataIntegrityError(f"the timeline has {wrong}")
    return rows


def canonical_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


def load_config(text: str, required: tuple[str, ...] = (), kinds: dict[str, type] | None = None) -> tuple[dict, str]:
    """(configuration, hash of its canonical form) of a YAML document. kinds: types of values by dotted path, each of
    which must be there and of that type."""
    config = yaml.safe_load(text) or {}
    if missing := [k for k in required if k not in config]:
        raise DataIntegrityError(f"missing sections: {', '.join(missing)}")
    for path, kind in (kinds or {}).items():
        value = config
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
            raise DataIntegrityError(f"{path} is no {kind.__name__}")
    return config, canonical_hash(config)


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(name, source) of the Python files under a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(folder)
    return rows.select(F.regexp_extract("path", r"([^/]+)\.py$", 1).alias("name"), F.col("content").cast("string").alias("source"))


def seed_everything(seed: int) -> None:
    random.seed(seed)
    np.random.seed(seed)


def logger(name: str) -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log
