"""Edge cases of polyline functions and of rows kept from ordered groups."""

from pyspark.sql import functions as F

from umbra.functions import lines
from umbra.operators import choices

LINE = "array<struct<x:double,y:double>>"


def _one(spark, values, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()]


def test_lines_without_points_and_nulls(spark):
    line = F.col("line")
    rows = [([],), ([(1.0, 2.0)],), ([None, (1.0, 2.0), None, (1.0, 2.0)],), (None,)]
    got = _one(spark, rows, f"line {LINE}", F.size(lines.cleaned(line)), lines.length(lines.cleaned(line)), lines.closed_area(lines.cleaned(line)))
    assert got[:3] == [(0, 0.0, 0.0), (1, 0.0, 0.0), (1, 0.0, 0.0)]
    assert got[3][1] is None
    assert _one(spark, [([],), ([(3.0, 4.0)],)], f"line {LINE}", F.size(lines.densified(line, 5.0))) == [(0,), (1,)]


def test_append_skips_one_joint_only(spark):
    rows = [([(0.0, 0.0)], [(0.0, 0.0), (0.0, 0.0)]), ([], [(1.0, 1.0)]), ([(1.0, 1.0)], [])]
    got = _one(spark, rows, f"a {LINE}, b {LINE}", F.size(lines.append(F.col("a"), F.col("b"))))
    assert got == [(2,), (1,), (1,)]


def test_flat_lists(spark):
    rows = [([],), ([1.0],), ([1.0, 2.0, 3.0],), (None,)]
    got = [r[0] for r in _one(spark, rows, "flat array<double>", lines.pairs_of(F.col("flat")))]
    assert [None if p is None else [tuple(x) for x in p] for p in got] == [[], [], [(1.0, 2.0)], None]


def test_centroid_of_a_flat_ring_is_its_mean(spark):
    rows = [([(0.0, 0.0), (4.0, 0.0), (0.0, 0.0)],), ([(0.0, 0.0), (3.0, 0.0), (0.0, 3.0), (0.0, 0.0)],)]
    got = _one(spark, rows, f"ring {LINE}", lines.centroid(F.col("ring")))
    assert [(round(p["x"], 6), round(p["y"], 6)) for (p,) in got] == [(1.333333, 0.0), (1.0, 1.0)]


def test_boxes_outside_the_area_or_with_nulls_are_null(spark):
    rows = [(1.0, 1.0, 2.0, 2.0), (19.9, 50.0, 19.8, 50.1), (None, 50.0, 20.0, 50.1), (19.0, 49.0, 21.0, 51.0)]
    got = _one(spark, rows, "w double, s double, e double, n double", lines.clamped_box(*(F.col(c) for c in "wsen")))
    assert got[:3] == [(None,)] * 3 and tuple(got[3][0]) == (19.78, 49.96, 20.22, 50.13)


def test_chosen_route_falls_back(spark):
    rows = [(1, "fast", 1), (1, "balanced", 2), (2, "fast", 1), (2, "quiet", 2), (3, "heat", 9), (3, "balanced", 1)]
    routes = spark.createDataFrame(rows, "trip int, profile string, at int")
    got = choices.chosen_route(routes, "trip", "profile", "at", F.lit("heat"))
    assert sorted((r["trip"], r["profile"]) for r in got.collect()) == [(1, "balanced"), (2, "fast"), (3, "heat")]
    assert choices.chosen_route(routes.limit(0), "trip", "profile", "at", F.lit("heat")).count() == 0
