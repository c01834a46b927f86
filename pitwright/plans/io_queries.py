"""Sources and sinks as queries: what they write to the shared folder is read back and compared with the tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from pitwright.operators import calendar, evaluate
from pitwright.plans.relational import ORACLES, QUERIES, query, sql, week
from pitwright.sources import files, panels
from pitwright.sources.panels import net_flow, table

__all__ = ["ORACLES", "QUERIES"]


def folder(spark) -> str:
    return f"{files.shared_dir(spark)}/io-{uuid.uuid4().hex}"


@query("s01_parquet_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s01(spark, sf):
    return files.read_parquet(spark, f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


FIRST = "(SELECT DISTINCT session_date FROM wk ORDER BY 1 LIMIT 4)"


@query("s02_session_files", sql(f"SELECT symbol, close FROM wk WHERE session_date IN {FIRST}"))
def s02(spark, sf):
    panel, at = week(spark, sf), folder(spark)
    days = [r["session_date"] for r in panel.select("session_date").distinct().orderBy("session_date").limit(4).collect()]
    paths = {str(d): f"{at}/{d}.parquet" for d in days}
    for d, path in zip(days, paths.values()):
        panel.where(F.col("session_date") == F.lit(d)).coalesce(1).write.parquet(path)
    return panels.read_sessions(spark, paths, ["symbol", "close"])


@query("s04_price_file", sql(f"SELECT session_date, symbol, open, high, low, close, volume, turnover_inr FROM wk WHERE session_date = (SELECT max(session_date) FROM {FIRST})"))
def s04(spark, sf):
    """A price file in the older layout: dates in capitals, turnover in rupees, other series between the equities."""
    panel = week(spark, sf)
    day = panel.select("session_date").distinct().orderBy("session_date").limit(4).agg(F.max("session_date")).first()[0]
    rows = panel.where(F.col("session_date") == F.lit(day)).collect()
    stamp = day.strftime("%d-%b-%Y").upper()
    line = lambda r, series: ",".join([r["symbol"], series, *[repr(r[c]) for c in ("open", "high", "low", "close", "close", "volume", "turnover_inr")], stamp])
    text = " SYMBOL, SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP\n" + "\n".join(line(r, s) for r in rows for s in ("EQ", "BE"))
    path = f"{folder(spark)}.csv"
    files.write_text(spark, path, text)
    return panels.read_price_csv(spark, path, str(day)).select("session_date", "symbol", "open", "high", "low", "close", "volume", "turnover_inr")


PEOPLE = [("Client", 1234, 5), ("DII", 20, 6), ("FII", 300, 7), ("Pro", 41, 8)]


@query("s06_participants", "SELECT DATE '2024-01-02' AS session_date, category, measure, contracts::BIGINT AS contracts FROM (VALUES " + ", ".join(f"('{c}', 'Total Long Contracts', {a}), ('{c}', 'Total Short Contracts', {b})" for c, a, b in PEOPLE) + ") t(category, measure, contracts)")
def s06(spark, sf):
    lines = ["title", "Client Type, Total Long Contracts , Total Short Contracts", *[f'{c},"{a:,}",{b}' for c, a, b in [*PEOPLE, ("TOTAL", 1595, 26)]]]
    return panels.parse_participants(spark.createDataFrame(list(enumerate(lines)), "number int, value string"), "2024-01-02")


@query("s07_timeline_file", "SELECT DATE '2020-01-01' + r_regionkey AS announced_date, CASE r_regionkey % 2 WHEN 0 THEN DATE '2021-03-01' ELSE DATE '2022-01-01' END AS effective_date, r_name AS title FROM region")
def s07(spark, sf):
    rows = table(spark, sf, "region").collect()
    line = lambda r: f"2020-01-{r['r_regionkey'] + 1:02d},{'2021-03' if r['r_regionkey'] % 2 == 0 else '2022'},rule,{r['r_name']},d,https://a"
    path = f"{folder(spark)}.csv"
    files.write_text(spark, path, "announced_date,effective_date,category,title,description,source_url\n" + "\n".join(map(line, rows)))
    return files.read_events(spark, path).select("announced_date", "effective_date", "title")


@query("s08_json_records", "SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region")
def s08(spark, sf):
    at = folder(spark)
    for r in table(spark, sf, "region").collect():
        files.write_text(spark, f"{at}/{r['r_regionkey']}.json", json.dumps({"key": r["r_regionkey"], "name": r["r_name"]}, indent=1))
    return files.read_records(spark, f"{at}/*.json", "key bigint, name string").select("key", "name")


@query("s09_k05_ledger", "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INT) AS seq, r_name AS name, 0::BIGINT AS problems FROM region")
def s09(spark, sf):
    path = f"{folder(spark)}.jsonl"
    for r in table(spark, sf, "region").orderBy("r_regionkey").collect():
        files.append_trial(spark, path, r["r_name"], "ok")
    ledger = files.read_ledger(spark, path)
    bad = evaluate.verify_ledger(ledger).groupBy("seq").agg(F.count("*").alias("problems"))
    return ledger.join(bad, "seq", "left").select("seq", "name", F.coalesce("problems", F.lit(0).cast("bigint")).alias("problems"))


@query("s10_index_sessions", sql("SELECT session_date, CAST(row_number() OVER (ORDER BY session_date) - 1 AS INT) AS session_idx FROM net"))
def s10(spark, sf):
    path = folder(spark)
    files.write_once(net_flow(spark, sf), path, "index levels")
    files.verify(spark, path)
    return calendar.build(files.read_parquet(spark, path))


CONFIG = {"costs": {"rate": 0.001, "flat": True}, "dates": ["2020-01-01"], "meta": {"name": "a"}}


@query("s12_configuration", f"SELECT sha256('{json.dumps(CONFIG, sort_keys=True, separators=(',', ':'))}') AS digest, 0.001::DOUBLE AS rate")
def s12(spark, sf):
    text = "meta:\n  name: a\ndates: ['2020-01-01']\ncosts:\n  flat: true\n  rate: 0.001\n"
    config, digest = files.load_config(text, ("meta", "costs"), {"costs.rate": float, "meta.name": str, "costs.flat": bool})
    return spark.createDataFrame([(digest, config["costs"]["rate"])], "digest string, rate double")


@query("s13_stitched_index", sql("SELECT session_date, round(net, 6) AS net FROM net"))
def s13(spark, sf):
    net = net_flow(spark, sf).withColumn("net", F.round("net", 6))
    middle = net.agg(F.percentile_approx(F.unix_date("session_date"), 0.5)).first()[0]
    early, late = (net.where(c) for c in (F.unix_date("session_date") < middle, F.unix_date("session_date") >= middle))
    return panels.stitch(early.unionByName(early), late)


@query("s14_source_folder", "SELECT r_name AS name, 'x = ' || r_regionkey AS source FROM region")
def s14(spark, sf):
    at = folder(spark)
    for r in table(spark, sf, "region").collect():
        files.write_text(spark, f"{at}/{r['r_name'].replace(' ', '_')}.py", f"x = {r['r_regionkey']}")
    files.write_text(spark, f"{at}/notes.txt", "no source")
    return files.read_sources(spark, at).withColumn("name", F.replace("name", F.lit("_"), F.lit(" ")))


@query("k01_k02_write_once_and_verify", "SELECT count(*) AS rows, 'test' AS source, true AS unchanged, true AS refused FROM customer")
def k01(spark, sf):
    path = folder(spark)
    meta = files.write_once(table(spark, sf, "customer"), path, "test")
    try:
        files.write_once(table(spark, sf, "region"), path, "again")
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "exist" in str(e).lower()
    again = files.verify(spark, path)
    return spark.createDataFrame([(meta["rows"], again["source"], again["sha256"] == meta["sha256"], refused)], "rows bigint, source string, unchanged boolean, refused boolean")


@query("k03_derived_partitions", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 10")
def k03(spark, sf):
    path = folder(spark)
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    files.write_derived(rows, path, "c_nationkey")
    files.write_derived(rows.where("c_nationkey < 10"), path, "c_nationkey")
    return spark.read.parquet(path).select("c_custkey", F.col("c_nationkey").cast("int").alias("c_nationkey"))


@query("k04_k06_manifest", "SELECT 1 AS runs, 'ValueError: no' AS error, true AS hashed, true AS configured")
def k04(spark, sf):
    path = f"{folder(spark)}.json"
    for fail in (False, True):
        try:
            with files.manifest(spark, path, config=CONFIG, paths={"region": f"{sf}/region.parquet"}, seed=1):
                if fail:
                    raise ValueError("no")
        except ValueError:
            pass
    kind = "error string, config_sha256 string, input_sha256 map<string,string>"
    read = spark.read.text(path).select(F.from_json("value", kind).alias("r")).select("r.*")
    own = files.canonical_hash(CONFIG)
    return read.groupBy().agg(F.count("*").cast("int").alias("runs"), F.first("error").alias("error"), F.first(F.length(F.col("input_sha256")["region"]) == 64).alias("hashed"), F.first(F.col("config_sha256") == own).alias("configured"))


@query("k07_sheets", "SELECT r_regionkey, r_name, 7 AS lines FROM region")
def k07(spark, sf):
    at = folder(spark)
    rows = table(spark, sf, "region").select("r_regionkey", "r_name")
    files.write_sheet(rows, f"{at}/sheet")
    files.write_markdown(rows, f"{at}/sheet.md")
    lines = spark.read.text(f"{at}/sheet.md").agg(F.count("*").cast("int").alias("lines"))
    return spark.read.schema(rows.schema).option("header", True).csv(f"{at}/sheet").join(F.broadcast(lines))
