import json

import pytest

from pitwright.functions.checks import DataIntegrityError
from pitwright.operators import audit, evaluate
from pitwright.sources import files, panels

HONEST = """
class Momentum:
    def __init__(self, lookback=20):
        self.lookback = lookback

    def generate(self, view):
        closes = view.closes(self.lookback)
        ranked = closes.sort("ret").head(10)
        return {s: 0.1 for s in ranked["symbol"].to_list()}
"""
LEAKY = {
    "future_indexing": "def f(view):\n    return view.closes(5).shift(-1)\n",
    "point_in_time_bypass": "class S:\n    def __init__(self, panel):\n        self.panel = panel\n    def generate(self, view):\n        return self.panel.filter(1)\n",
    "full_sample_statistic": "class S:\n    def __init__(self, panel):\n        self.level = panel['close'].mean()\n        self.panel = panel\n    def generate(self, view):\n        return self.panel['close'].mean()\n",
    "full_sample_fit": "class S:\n    def __init__(self, panel):\n        self.panel = panel\n    def generate(self, view):\n        return self.model.fit(self.panel['x'])\n",
    "boundary_crossing_window": "def f(view):\n    return view.closes(5).rolling(5, center=True)\n",
    "survivorship_selection": "import polars as pl\nDATA = pl.read_parquet('x')\nclass S:\n    def generate(self, view):\n        return DATA.filter(DATA['d'] == DATA['d'].max())\n",
    "target_in_features": "def f(view, rows):\n    y = view.closes(5).shift(-1)\n    rows.append(y)\n",
    "future_indexing slice": "def f(series, t):\n    return series[t + 1:]\n",
    "future_indexing reversed": "def f(view):\n    return view.history(5).reverse().rolling_min(3)\n",
    "full_sample_fit renamed": "class N:\n    def calibrate(self, rows):\n        self.c = rows.group_by('symbol').mean()\n        return self\nclass S:\n    def __init__(self, book):\n        self.n = N().calibrate(book)\n",
    "survivorship_selection variable": "class S:\n    def __init__(self, members):\n        last = members['day'].max()\n        self.names = members.filter(col('day') == last)['symbol'].to_list()\n    def generate(self, view):\n        return [s for s in view.symbols if s in self.names]\n",
    "target_in_features branch": "def f(df, feats):\n    if df:\n        y = df.shift(-1)\n    feats.append(y)\n",
    "target_in_features returned": "class S:\n    def generate(self, view):\n        edge = view.closes().shift(-1)\n        return edge\n",
    "future_indexing as_of": "class S:\n    def __init__(self, p):\n        self.p = p\n    def generate(self, view):\n        return self.p.filter(col('day') == view.as_of)\n",
    "point_in_time_bypass file": "import polars as pl\ndef rows():\n    return pl.read_parquet('x')\nclass S:\n    def generate(self, view):\n        return rows()\n",
    "snooped_parameter": "class S:\n    def __init__(self):\n        best = 0\n        for n in [5, 10, 20]:\n            if score(n) > best:\n                best = n\n",
}


def test_audit_catches_each_class_and_leaves_honest_code(spark):
    assert audit.audit_source(HONEST) == []
    for leak, source in LEAKY.items():
        assert leak.split()[0] in {f.leak_class for f in audit.audit_source(source)}, leak
    assert [f.severity for f in audit.audit_source("def (")] == ["high"]
    rows = spark.createDataFrame([("honest", HONEST), ("none", None), *LEAKY.items()], "name string, source string")
    got = {r.name: r.rejected for r in audit.findings(rows).collect()}
    assert not got["honest"] and not got["none"] and all(got[n] for n in LEAKY)
    assert audit.conforms(HONEST) == (True, "Momentum") and audit.conforms("x = 1") == (False, None)
    assert audit.first_object('noise {bad} {"a": {"b": 1}} {"c": 2}') == {"a": {"b": 1}} and audit.first_object("{") is None


@pytest.mark.parametrize(
    "source",
    [
        "def f(df):\n    return df['close'].shift(1)\n",
        "class S:\n    def __init__(self, lookback=63):\n        self.n = lookback\n    def generate(self, view):\n        c = view.closes(self.n)\n        w = c.filter(c['x'] > c['x'].mean())['symbol'].to_list()\n        return {s: 1 / len(w) for s in w}\n",
        "class S:\n    def generate(self, view):\n        target_weight = 1.0 / len(view.symbols)\n        return {s: target_weight for s in view.symbols}\n",
        "def f(window):\n    return sum(window) / len(window)\n",
        "",
    ],
)
def test_honest_sources_are_not_rejected(source):
    assert not any(f.severity == "high" for f in audit.audit_source(source))


def test_write_once_and_verify(spark, tmp_path):
    path = f"file://{tmp_path}/raw"
    meta = files.write_once(spark.range(5), path, "test")
    assert files.verify(spark, path)["rows"] == meta["rows"] == 5
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        files.write_once(spark.range(5), path, "test")
    spark.range(6).write.mode("overwrite").parquet(path)
    with pytest.raises(DataIntegrityError):
        files.verify(spark, path)
    with pytest.raises(DataIntegrityError):
        files.read_parquet(spark, f"{path}-none")


def test_ledger_and_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/trials.jsonl"
    for name in ("a", "b", "c"):
        files.append_trial(spark, path, name, "ok")
    assert evaluate.verify_ledger(files.read_ledger(spark, path)).count() == 0
    with pytest.raises(RuntimeError), files.manifest(spark, f"file://{tmp_path}/run.json", x=1):
        raise RuntimeError("no")
    record = json.loads((tmp_path / "run.json").read_text())
    assert record["error"] == "RuntimeError: no" and record["inputs"] == {"x": 1}
    config, own = files.load_config("a: 1\nb: [2]")
    assert config == {"a": 1, "b": [2]} and own == files.load_config("b: [2]\na: 1")[1]
    with pytest.raises(DataIntegrityError):
        files.load_config("a: 1", ("b",))


def test_price_and_participant_files(spark, tmp_path):
    head = "SYMBOL, SERIES, DATE1, PREV_CLOSE, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, CLOSE_PRICE, TTL_TRD_QNTY, TURNOVER_LACS\n"
    good = head + 'A, EQ, 02-Jan-2024, 9, 10, 12, 9, 11, "1,000", 2.5\nB, BE, 02-Jan-2024, 1, 1, 1, 1, 1, 1, 1\n'

    def read(text, day="2024-01-02"):
        (tmp_path / "p.csv").write_text(text)
        return panels.read_price_csv(spark, f"file://{tmp_path}/p.csv", day).collect()

    assert [(r.symbol, r.close, r.volume, r.turnover_inr) for r in read(good)] == [("A", 11.0, 1000.0, 250_000.0)]
    assert len(read(good.replace("02-Jan-2024", "2024-01-02"))) == 1 and len(read(good.replace("02-Jan-2024", "02-JANUARY-2024"))) == 1
    old = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,ISIN\nA,EQ,10,12,9,11,9,1000,11000,02-JAN-2020,X\n"
    assert [(r.close, r.turnover_inr) for r in read(old, "2020-01-02")] == [(11.0, 11_000.0)]
    for text, why in [
        (head + "A, BE, 02-Jan-2024, 9, 10, 12, 9, 11, 1000, 2.5\n", "no equity rows"),
        (good.replace("02-Jan", "01-Jan"), "is of 2024-01-01"),
        (good + "C, EQ, 03-Jan-2024, 9, 10, 12, 9, 11, 1000, 2.5\n", "bears 2 dates"),
        (good.replace("02-Jan-2024", ""), "bears 0 dates"),
        (good.replace("02-Jan-2024", "02/01/2024"), "can't be read"),
        (good.replace(", 11,", ", 0,"), "positive close"),
        ("<!DOCTYPE html>\n<html></html>", "web page"),
        ("\n", "is empty"),
        (good.replace("DATE1", "DAY"), "missing columns DATE1"),
    ]:
        with pytest.raises(DataIntegrityError, match=why):
            read(text)
    assert spark.range(1).select(panels.session_path("/raw", "2024-01-02")).first()[0] == "/raw/prices/session_date=2024-01-02"
    days = lambda *d: spark.createDataFrame(d, "session_date string, close double")
    assert sorted(map(tuple, panels.stitch(days(("a", 2.0), ("a", 1.0)), days(("b", 3.0))).collect())) == [("a", 1.0), ("b", 3.0)]
    with pytest.raises(DataIntegrityError):
        panels.stitch(days(("a", 2.0)), days(("a", 3.0)))
    names = "Client Type,Future Index Long,Future Index Short,Total Long Contracts,Total Short Contracts"
    lines = ["title", names, *[f'{c},1,2,"1,0{i}",4' for i, c in enumerate(("Client", "DII", "FII", "Pro", "TOTAL"))]]
    table = spark.createDataFrame(list(enumerate(lines)), "number int, value string")
    rows = panels.parse_participants(table, "2024-01-02")
    assert rows.count() == 16 and {r.contracts for r in rows.where("category = 'FII' and measure = 'Total Long Contracts'").collect()} == {102}
    from pitwright.operators.capacity import net_positions

    assert [r.net for r in net_positions(rows).collect()] == [98]
    with pytest.raises(DataIntegrityError):
        panels.parse_participants(table.where("value not like 'DII%'"), "2024-01-02")


def test_timeline(spark):
    good = ("2024-01-01", "2024-02-01", "rule", "t", "d", "https://x")
    kind = "announced_date string, effective_date string, category string, title string, description string, source_url string"
    make = lambda *rows: spark.createDataFrame(list(rows), kind)
    assert files.validate_events(make(good)).count() == 1
    for bad in (("2024-03-01", *good[1:]), (*good[:5], "http://x"), (*good[:3], " ", *good[4:])):
        with pytest.raises(DataIntegrityError):
            files.validate_events(make(bad))
    with pytest.raises(DataIntegrityError):
        files.validate_events(make(good, good))
