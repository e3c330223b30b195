"""Small cases for operators that SQL can't express, sources, and streams."""

import json

from pyspark.sql import functions as F

from umbra.operators.components import connected_components
from umbra.operators.graph import largest_component, shortest_paths
from umbra.sources import readers
from umbra.streaming import fixes


def test_components_of_chain_and_loop(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)], "src long, dst long")
    got = dict(connected_components(edges).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert connected_components(edges.limit(0)).count() == 0


def test_largest_component_by_length(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (3, 4, 3.0), (4, 5, 3.0)], "src long, dst long, length_m double")
    assert sorted(r.src for r in largest_component(edges).collect()) == [3, 4]


def test_shortest_paths_match_dijkstra(spark):
    import heapq
    import random

    random.seed(4)
    edges = [(random.randrange(30), random.randrange(30), float(random.randrange(1, 20))) for _ in range(60)]
    around = {}
    for a, b, c in edges:
        around.setdefault(a, []).append((b, c))
        around.setdefault(b, []).append((a, c))
    best, heap = {}, [(0.0, edges[0][0])]
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in best:
            best[node] = cost
            for other, c in around.get(node, ()):
                heapq.heappush(heap, (cost + c, other))
    df = spark.createDataFrame(edges, "src long, dst long, cost double")
    start = spark.createDataFrame([(edges[0][0],)], "node long")
    assert dict(shortest_paths(df, start).collect()) == best


def test_tile_reader_drops_misaligned_ways(spark, tmp_path):
    point = {"lat": 50.0, "lon": 20.0}
    tile = {"version": 0.6, "elements": [
        {"type": "way", "id": 1, "tags": {"highway": "path"}, "nodes": [5, 6], "geometry": [point, point]},
        {"type": "way", "id": 2, "nodes": [5], "geometry": [point, point]},
        {"type": "node", "id": 9, "lat": 50.1, "lon": 20.1}]}
    (tmp_path / "a.json").write_text(json.dumps(tile))
    found = readers.elements(spark, str(tmp_path))
    assert found.count() == 3
    assert [(r.way_id, r.seq, r.node_id) for r in readers.way_nodes(found).orderBy("seq").collect()] == [(1, 0, 5), (1, 1, 6)]


def test_hourly_drops_empty_hours(spark, tmp_path):
    hours = {"time": ["2026-07-01T10:00", "2026-07-01T11:00"], "temperature_2m": [20.5, None], "cloud_cover": [10.0, None]}
    (tmp_path / "h.json").write_text(json.dumps({"hourly": hours}))
    assert [(r.temperature_c, r.uv) for r in readers.hourly(spark, str(tmp_path)).collect()] == [(20.5, None)]


def test_text_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("NCOLS 2\nnrows 2\nxllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2\n-9999 4e0\n")
    got = {(r.row, r.col): r.value for r in readers.text_grid(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): None, (1, 1): 4.0}


def test_event_stream_skips_comments_and_bad_json(spark):
    df = spark.createDataFrame([(": hi\r\ndata: {\"a\":1}\r\n\r\ndata: {bad\n\ndata: 2",)], "t string")
    assert df.select(readers.stream_events(F.col("t"))).first()[0] == ['{"a":1}', "2"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 3).alias("user_id"), F.timestamp_seconds(1700000000 + F.col("id") * 7).alias("ts"), (F.col("id") % 50).cast("double").alias("offset_m"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = fixes.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("counts")) == key(fixes.windowed_counts(rows))
