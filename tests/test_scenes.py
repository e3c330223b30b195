"""Edge cases of rays, zones and progress."""

import math

import pytest
from pyspark.sql import functions as F

from umbra.operators import scene, zones

RAY = "rid long, x double, y double, azimuth double, altitude double, leaf_off boolean"
BODY = "oid long, kind string, ring array<struct<x double, y double>>, top double, bottom double"
TREE = "oid long, x double, y double, height double, radius double, evergreen boolean"


def _square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def _exposed(spark, rays, bodies=(), trees=()):
    out = scene.exposure(spark.createDataFrame(rays, RAY), spark.createDataFrame(list(bodies), BODY), spark.createDataFrame(list(trees), TREE))
    return {r["rid"]: r["exposure"] for r in out.collect()}


def test_empty_scene_and_no_sun(spark):
    rays = [(1, 0.0, 0.0, 1.0, 0.5, None), (2, 0.0, 0.0, 1.0, 0.0, False), (3, 0.0, 0.0, 1.0, None, False)]
    assert _exposed(spark, rays) == {1: 1.0, 2: 0.0, 3: 0.0}
    assert _exposed(spark, []) == {}


def test_walls_inside_and_over(spark):
    north, south = 0.0, math.pi
    rays = [(1, 5.0, -50.0, north, 0.1, False), (2, 5.0, -50.0, south, 0.1, False), (3, 5.0, -50.0, north, 1.2, False), (4, 5.0, 5.0, north, 1.5, False)]
    assert _exposed(spark, rays, [(1, "building", _square(0.0, 0.0, 10.0), 20.0, 0.0)]) == {1: 0.0, 2: 1.0, 3: 1.0, 4: 0.0}


def test_below_a_hanging_body(spark):
    """Under a passage from 10 to 20 m high the sun comes in below it, and is barred where the ray rises into it."""
    rays = [(1, 5.0, -50.0, 0.0, math.atan(0.1), False), (2, 5.0, -50.0, 0.0, math.atan(0.16), False), (3, 5.0, -50.0, 0.0, math.atan(0.3), False)]
    assert _exposed(spark, rays, [(1, "building", _square(0.0, 0.0, 10.0), 20.0, 10.0)]) == {1: 1.0, 2: 0.0, 3: 0.0}


def test_canopies_and_crowns_count_once(spark):
    canopies = [(1, "canopy", _square(0.0, 0.0, 100.0), 12.0, 0.0)]
    rays = [(1, 5.0, -5.0, 0.0, 0.1, False), (2, 5.0, -5.0, 0.0, 0.1, True), (3, 50.0, 50.0, 0.0, 0.1, False)]
    assert _exposed(spark, rays, canopies) == pytest.approx({1: 0.3, 2: 0.75, 3: 0.15})
    tree = [(1, 0.0, 40.0, 4.0, 2.0, None)]
    through = [(1, 0.0, 0.0, 0.0, math.atan(0.5 / 40), False), (2, 0.0, 0.0, 0.0, math.atan(0.5 / 40), True)]
    assert _exposed(spark, through, trees=tree) == pytest.approx({1: 0.25, 2: 0.7})


def test_cells_do_not_change_the_result(spark):
    bodies = [(i, "building" if i % 3 else "canopy", _square(i * 17.3 % 300, i * 41.9 % 300, 4.0 + i % 9), 4.0 + i % 25, 3.0 if i % 4 == 1 else 0.0) for i in range(60)]
    trees = [(i, i * 31.7 % 300, i * 53.3 % 300, 3.0 + i % 12, 1.0 + i % 4, i % 2 == 0) for i in range(60)]
    rays = spark.createDataFrame([(i, i * 11.1 % 300, i * 23.7 % 300, i * 0.77 % 6.28, 0.03 + i % 10 * 0.1, i % 2 == 0) for i in range(80)], RAY)
    made = [spark.createDataFrame(bodies, BODY), spark.createDataFrame(trees, TREE)]
    got = [{r["rid"]: round(r["exposure"], 9) for r in scene.exposure(rays, *made, size=size).collect()} for size in (40.0, 7.0, 500.0)]
    assert got[0] == got[1] == got[2] and len(set(got[0].values())) > 3


def test_zone_of_a_degenerate_ring(spark):
    rings = spark.createDataFrame([(1, [(1.0, 1.0), (4.0, 1.0)]), (2, []), (3, None), (4, _square(-5.0, -5.0, 7.0))], "rid long, ring array<struct<x double, y double>>")
    assert sorted((r["rid"], r["row"], r["col"]) for r in zones.zone_cells(rings, 1.0, 10, 10).collect()) == [(4, i, j) for i in (0, 1) for j in (0, 1)]


@pytest.mark.parametrize(("top", "tree", "skirt", "base"), [(4.0, 4.0, None, 0.8), (20.0, 20.0, None, 6.0), (20.0, 20.0, 9.0, 5.4), (20.0, 20.0, 90.0, 8.0), (20.0, 20.0, 1.0, 4.0), (2.5, 20.0, None, 1.0), (1.0, 3.0, None, 0.5)])
def test_crown_base(spark, top, tree, skirt, base):
    row = spark.createDataFrame([(top, tree, skirt)], "top double, tree double, skirt double")
    assert row.select(zones.crown_base(F.col("top"), F.col("tree"), F.col("skirt")).alias("b")).first()["b"] == pytest.approx(base)


def test_turns_at_ends_and_short_lines(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 20.0), (1, 2, 20.0, 20.0), (1, 3, 20.0, 20.0), (2, 0, 3.0, 3.0)], "way long, seq int, x double, y double")
    assert sorted((r["way"], r["at"], r["angle"]) for r in zones.turns(points, "way", ["seq"]).collect()) == [(1, 0.0, 0.0), (1, 20.0, 90.0), (1, 40.0, 0.0), (2, 0.0, 0.0)]


def test_snap_prefers_the_hint(spark):
    """A route out and back on itself: the hint picks the way, unless another place is nearer by far."""
    route = spark.createDataFrame([(1, 0, 0.0, 0.0, 200.0, 0.0, 0.0), (1, 1, 200.0, 0.0, 200.0, 20.0, 200.0), (1, 2, 200.0, 20.0, 0.0, 20.0, 220.0)], "r long, seg int, ax double, ay double, bx double, by double, cum double")
    fixes = spark.createDataFrame([(1, 1, 50.0, 4.0, None), (2, 1, 50.0, 4.0, 340.0), (3, 1, 20.0, -30.0, 280.0), (4, 9, 0.0, 0.0, None)], "fid long, r long, px double, py double, hint double")
    assert {r["fid"]: (r["along_m"], r["offset_m"]) for r in zones.snap(fixes, route, "r").collect()} == {1: (50.0, 4.0), 2: (370.0, 16.0), 3: (20.0, 30.0)}


def test_step_at(spark):
    cases = [([], 5.0, -1), ([0.0], 5.0, 0), ([0.0, 50.0, 90.0], 47.0, 0), ([0.0, 50.0, 90.0], 48.0, 1), ([0.0, 50.0, 90.0], 500.0, 1), ([10.0, 20.0], 1.0, 0)]
    rows = spark.createDataFrame([(i, s, a) for i, (s, a, _) in enumerate(cases)], "i int, s array<double>, a double")
    got = {r["i"]: r["n"] for r in rows.select("i", zones.step_at(F.col("s"), F.col("a")).alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == [n for _, _, n in cases]


def test_crowns_that_coincide_are_met_once_and_never_by_dark_rays(spark):
    trees = [(i, 10.0, 0.0, 6.0, 2.0, False) for i in range(3)] + [(9, 10.0, 0.0, 6.0, 2.0, True)]
    trees = spark.createDataFrame(trees, "oid long, x double, y double, height double, radius double, evergreen boolean")
    ring = "array<struct<x:double,y:double>>"
    bodies = spark.createDataFrame([(1, "building", [(-40.0, 18.0), (40.0, 18.0), (40.0, 22.0), (-40.0, 22.0)], 30.0, 0.0)], f"oid long, kind string, ring {ring}, top double, bottom double")
    rays = [(1, 0.0, 0.0, math.pi / 2, 0.25, True), (2, 0.0, 0.0, 0.0, 0.25, True)]
    rays = spark.createDataFrame(rays, "rid long, x double, y double, azimuth double, altitude double, leaf_off boolean")
    found = scene.exposure(rays, bodies, trees)
    one = {r.rid: r.exposure for r in scene.exposure(rays, bodies, trees.where("oid = 0")).collect()}
    last = {r.rid: r.exposure for r in scene.exposure(rays, bodies, trees.where("oid = 9")).collect()}
    got = {r.rid: r.exposure for r in found.collect()}
    assert 0.05 < one[1] < 1 and got == pytest.approx({1: max(0.05, one[1] ** 3 * last[1]), 2: 0.0})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "count(1)" in plan
