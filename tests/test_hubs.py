"""Components with hubs, and tasks for as many rows as there are."""

from pyspark.sql import functions as F

from umbra import shared
from umbra.operators import components


def test_no_task_sorts_a_whole_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 50)
    # Two hubs, one smaller and one larger than its leaves, a bridge and a loop.
    edges = [(0, i) for i in range(1, 300)] + [(2000, i) for i in range(1000, 1300)] + [(299, 300), (5000, 5000)]
    frame = spark.createDataFrame(edges, "src long, dst long").where(F.col("src") >= 0)
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1300)} | {2000: 1000, 5000: 5000}
    rows, least = frame.select(F.col("dst").alias("u"), F.col("src").alias("v")), frame.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
    assert "BroadcastHashJoin" in components._with_least(rows, least, "v", len(edges))._jdf.queryExecution().executedPlan().toString()


def test_a_stash_has_tasks_for_its_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    rows = spark.range(5000).select((F.col("id") % 4000).alias("k")).groupBy("k").count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert shared._parts(spark, 5000)["spark.sql.shuffle.partitions"] == "50" and shared._parts(spark, 100) == {}
    assert shared.stash(rows, "sized", 5000).count() == 4000
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
