"""Steps whose rows grow with their input: what joins give, what is sent to all tasks, frames that run once; results against plain loops."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from umbra.functions import lines, times
from umbra.operators import marches, rasters, routes, scene, spatial


def _rows_by_node(df):
    """Names of a plan's nodes with the rows each gave when ``df`` was collected."""
    df.collect()
    found = []

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        found.append((kind, metric.get().value() if metric.isDefined() else 0))
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def _most(df, kind=""):
    return max((n for name, n in _rows_by_node(df) if kind in name), default=0)


def test_slots_by_whole_milliseconds(spark):
    moments = ["2024-01-01 00:09:59.9994", "2024-01-01 00:09:59.9996", "2024-01-01 00:10:00", "1969-12-31 23:49:59.9996", "1969-12-31 23:49:59.9994"]
    df = spark.createDataFrame([(m,) for m in moments], "m string").select(times.bucket(F.to_timestamp("m"), 10).alias("slot"))
    assert [r.slot for r in df.collect()] == [2840112, 2840113, 2840113, -1, -2]


def test_asof_meets_no_slot_as_a_whole(spark):
    random.seed(3)
    day = datetime(2024, 1, 1)
    at = lambda: day + timedelta(microseconds=random.randrange(1_500_000_000) // 1000 * 1000)
    left, right = [(i, at()) for i in range(400)] + [(900, day + timedelta(days=1)), (901, None)], [(at(), i) for i in range(400)]
    right += [(left[0][1], 7), (left[0][1], 3)]
    found = spatial.asof_nearest(spark.createDataFrame(left, "k int, ts timestamp"), spark.createDataFrame(right, "r_ts timestamp, n int"), "ts", "r_ts", 60, "k")
    want = {}
    for k, ts in left:
        near = [(abs(r - ts), r, n) for r, n in right if ts and abs(r - ts) <= timedelta(seconds=60)]
        want[k] = min(near)[1:] if near else (None, None)
    assert {r.k: (r.r_ts, r.n) for r in found.collect()} == want
    dense = spark.range(2000).select(F.col("id").alias("k"), F.timestamp_micros(F.col("id") * 7).alias("ts"))
    assert _most(spatial.asof_nearest(dense, dense.select(F.col("ts").alias("r_ts"), F.col("k").alias("n")), "ts", "r_ts", 600, "k")) < 50_000


def test_places_and_lines_are_compared_once(spark):
    points = spark.range(3000).select(F.col("id").alias("pid"), (F.col("id") % 3 * 10.0).alias("px"), F.lit(0.5).alias("py"))
    segments = spark.range(500).select((500 - F.col("id")).alias("sid"), (F.col("id") % 5 * 10.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") % 5 * 10.0 + 8).alias("x1"), F.lit(0.0).alias("y1"))
    ranked = spatial.nearest_segments(points, segments, 30.0, 3)
    of = lambda p: [s for _, s in sorted((abs(max(0, x - p * 10, p * 10 - x - 8)), s) for s in range(1, 501) for x in [(500 - s) % 5 * 10])[:3]]
    got = {}
    for r in ranked.orderBy("pid", "dist", "sid").collect():
        got.setdefault(r.pid, []).append(r.sid)
    assert got == {p: of(p % 3) for p in range(3000)}
    nearest = spatial.nearest_segment(points, segments, 30.0)
    assert {r.pid: r.sid for r in nearest.collect()} == {p: s[0] for p, s in got.items()}
    assert _most(nearest) < 20_000 and _most(ranked) < 20_000
    assert spatial.near_segments(points.where("pid < 6"), segments, 9.0).groupBy("pid").count().where("pid = 0").first()["count"] == 100


def test_rings_of_one_shape_are_tested_once(spark):
    points = spark.range(2000).select(F.col("id").alias("pid"), (F.col("id") % 4 + 0.5).alias("px"), F.lit(0.5).alias("py"))
    corner = lambda x, y: F.struct((F.col("x") + x).alias("x"), F.lit(float(y)).alias("y"))
    rings = spark.range(40).withColumn("x", (F.col("id") % 2).cast("double")).select(F.col("id").alias("rid"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    found = rasters.in_rings(points, rings, 60.0)
    assert {(r.pid, r.rid) for r in found.collect()} == {(p, r) for p in range(2000) for r in range(40) if p % 4 == r % 2}
    # Pairs of different places and shapes, then pairs of rows: nothing else is as large as the answer.
    assert sorted(n for name, n in _rows_by_node(found) if "Join" in name)[-2] <= 2000


def test_spread_rays_are_not_sent_to_all_tasks(spark):
    i = F.col("id")
    rays = spark.range(200).select(i.alias("rid"), (50.0 + i % 7).alias("x"), (40.0 + i % 5).alias("y"), (i * 0.1).alias("azimuth"), (0.02 + i % 9 / 50).alias("altitude"), (i % 2 == 0).alias("leaf_off"), F.lit(1.5).alias("level"))
    raster = spark.range(1600).select(F.floor(F.col("id") / 40).alias("row"), (F.col("id") % 40).alias("col"), (F.col("id") * 7 % 13 + 1.0).alias("value"), F.lit(None).cast("double").alias("base"), *(F.col("id").alias(f"c{i}") for i in range(8)))
    for found in (marches.through_vegetation(rays, raster, 2.5), marches.behind_terrain(rays, raster, 2.5)):
        assert _most(found, "BroadcastExchange") <= 1600


def test_filling_and_rows_between_points(spark):
    cells = spark.range(64).select((F.col("id") % 8).alias("row"), F.floor(F.col("id") / 8).alias("col"), F.when(F.col("id") % 9 == 4, F.col("id") * 1.0).alias("value"))
    assert "unboundedfollowing" not in rasters.nearest_filled(cells)._jdf.queryExecution().executedPlan().toString().lower()
    random.seed(5)
    points = [(w, s, random.uniform(0, 50), random.uniform(0, 50)) for w in range(6) for s in range(w + 1)] + [(9, 0, 1.0, 1.0), (9, 1, 1.0, 1.0)]
    df = spark.createDataFrame(points, "way int, seq int, x double, y double")
    got = {}
    for r in routes.densified(df, "way", "seq", 7.0).orderBy("way", "seq", "k").collect():
        got.setdefault(r.way, []).append((r.x, r.y))
    arrays = df.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: lines.point(p["x"], p["y"])).alias("line"))
    assert got == {r.way: [tuple(p) for p in r.dense] for r in arrays.select("way", lines.densified(F.col("line"), 7.0).alias("dense")).collect()}


def test_a_crown_counts_once_however_many_cells_it_covers(spark):
    random.seed(8)
    rays = [(i, random.uniform(0, 90), random.uniform(0, 90), random.uniform(0, 6.28), random.uniform(0.02, 1.2), i % 3 == 0) for i in range(150)]
    trees = [(i, random.uniform(0, 90), random.uniform(0, 90), random.uniform(3, 20), random.uniform(1, 9), i % 4 == 0) for i in range(60)]
    rays = spark.createDataFrame(rays, "rid int, x double, y double, azimuth double, altitude double, leaf_off boolean")
    trees = spark.createDataFrame(trees, "oid int, x double, y double, height double, radius double, evergreen boolean")
    bodies = spark.createDataFrame([], "oid int, kind string, ring array<struct<x: double, y: double>>, top double, bottom double")
    coarse, fine = ({r.rid: r.exposure for r in scene.exposure(rays, bodies, trees, size).collect()} for size in (500.0, 4.0))
    assert coarse.keys() == fine.keys() and all(math.isclose(coarse[k], fine[k], abs_tol=1e-9) for k in coarse)
    assert len({round(v, 6) for v in fine.values()}) > 20
    # Crowns are folded by ray, not by ray and crown, and nothing spread over cells is sent to all tasks.
    assert _most(scene.exposure(rays, bodies, trees, 4.0), "BroadcastExchange") <= 150
