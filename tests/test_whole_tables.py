"""Graph, component and raster queries take whole tables; compared with plain loops."""

import os
import random

from umbra import queries
from umbra.operators import graph

SF = os.environ.get("UMBRA_TEST_SF", "/root/testdata/sf0.001")


def _roots(edges):
    parent = {n: n for e in edges for n in e[:2]}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b, *_ in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in parent}


def _totals(edges, roots):
    totals = {}
    for a, _, length in edges:
        totals[roots[a]] = totals.get(roots[a], 0.0) + length
    return totals


def test_components_of_all_line_items(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    edges = [(r.l_orderkey, r.l_partkey + 100_000_000, float(r.l_quantity)) for r in rows]
    roots = _roots(edges)
    assert {r.node: r.component for r in queries.QUERIES["agg_04_components"](spark, SF).collect()} == roots


def test_longest_component(spark):
    edges = [(1, 2, 1.0), (2, 3, 1.0), (7, 8, 5.0), (9, 9, 0.5), (20, 21, 2.5), (21, 22, 2.5)]
    roots = _roots(edges)
    totals = _totals(edges, roots)
    got = graph.measured_components(spark.createDataFrame(edges, "src long, dst long, length_m double")).collect()
    assert sorted(map(tuple, got)) == sorted((n, c, totals[c], c == 7) for n, c in roots.items())


def _graph(ways, blocked):
    usage, names, edges = {}, {}, []
    for nodes in ways.values():
        for i, (n, _, _) in enumerate(nodes):
            usage[n] = usage.get(n, 0) + (2 if i in (0, len(nodes) - 1) else 1)
    name = lambda n, *own: names.setdefault((n, *own) if n in blocked else n, len(names))
    for way, nodes in sorted(ways.items()):
        start = piece = 0
        for i in range(1, len(nodes)):
            if i < len(nodes) - 1 and usage[nodes[i][0]] < 2 and nodes[i][0] not in blocked:
                continue
            piece += 1
            part = nodes[start : i + 1]
            length = sum(((x - u) ** 2 + (y - v) ** 2) ** 0.5 for (_, u, v), (_, x, y) in zip(part, part[1:]))
            a, b = name(part[0][0], way, piece, 0), name(part[-1][0], way, piece, 1)
            start = i
            if a != b or length > 0:
                edges.append((a, b, length, way, piece))
    roots = _roots(edges)
    totals = _totals([e[:3] for e in edges], roots)
    main = max(totals, key=lambda c: (totals[c], -c))
    new = {n: k for k, n in enumerate(sorted(n for n in roots if roots[n] == main))}
    return sorted((way, piece, new[a], new[b], round(length, 6)) for a, b, length, way, piece in edges if a in new)


def test_walk_graph_equals_plain_build(spark):
    draw = random.Random(3)
    at = {n: (float(draw.randrange(50)), float(draw.randrange(50))) for n in range(60)}
    ways = {w: [(n, *at[n]) for n in draw.choices(range(60), k=draw.randrange(1, 7))] for w in range(25)}
    rows = [(w, s, *n) for w, nodes in ways.items() for s, n in enumerate(nodes)]
    frame = spark.createDataFrame(rows, "way_id long, seq int, node_id long, x double, y double")
    for blocked in ([], [3, 5, 8, 13, 21, 34, 55]):
        shut = spark.createDataFrame([(n,) for n in blocked], "node_id long")
        got = sorted((r.way_id, r.piece, r.src, r.dst, round(r.length_m, 6)) for r in graph.walk_graph(frame, shut).collect())
        assert got == _graph(ways, set(blocked))


def test_rows_beyond_the_hundredth_are_dilated(spark):
    assert queries.QUERIES["win_20_dilate_whole"](spark, SF).where("row > 101").count() > 0
