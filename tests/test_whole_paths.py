from pyspark.sql import functions as F

from pitwright import catalog
from pitwright.operators import stress

SF = "/root/testdata/sf0.001"


def test_paths_are_drawn_over_all_sessions(spark, monkeypatch):
    asked, draw = [], stress.bootstrap_paths
    monkeypatch.setattr(stress, "bootstrap_paths", lambda s, n, paths, *a, **k: asked.append((n, paths)) or draw(s, n, paths, *a, **k))
    battery = catalog.QUERIES["r09_moment_battery"](spark, SF)
    panel = catalog.QUERIES["r10_synthetic_panel"](spark, SF)
    (n, many), (sessions, some) = asked
    assert n + 1 == sessions > 60 and (many, some) == (1000, 100)
    assert battery.count() == 1000
    assert panel.select("path_id").distinct().count() == 100 and panel.groupBy("path_id").agg(F.max("steps").alias("n")).where(f"n > {sessions}").count() == 0
