"""Rings, masks, fills and ordered automata against plain loops."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from umbra.operators import automata, chains, graph, rasters, rings

POINTS = "element long, role string, piece long, seq long, x double, y double"


def _pieces(element, role, lines):
    return [(element, role, p, i, None if c is None else float(c[0]), None if c is None else float(c[1])) for p, line in enumerate(lines) for i, c in enumerate(line)]


def _rings(spark, rows):
    found = {}
    for r in sorted(rings.assembled(spark.createDataFrame(rows, POINTS)).collect(), key=lambda r: r.seq):
        found.setdefault((r.element, r.role, r.ring), []).append((r.x, r.y))
    return found


def test_lines_close_to_rings(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    rows = _pieces(1, "outer", [square[:2] + [None, (10, 0)], square[1:3], [(0, 0), (0, 10)], [(0, 10), (10, 10)]])  # one reversed, a null and a repeat
    rows += _pieces(2, "outer", [square[:3], square[2:]])  # open
    rows += _pieces(3, "outer", [[*square, (0, 0)]]) + _pieces(3, "inner", [[(1, 1), (2, 1), (1, 1)], [(3, 3), (4, 3), (4, 4), (3, 3)]])  # closed lines, one too short
    touching = [[(0, 0), (5, 0), (5, 5)], [(5, 5), (0, 5), (0, 0)], [(5, 5), (9, 5), (9, 9)], [(9, 9), (5, 9), (5, 5)]]
    rows += _pieces(4, "outer", touching)
    rows += _pieces(5, "outer", [[(0, 0), (1, 0)], [(1, 0), (0, 0)]])  # closes with three points
    rows += _pieces(6, "outer", [[(0.001, 0), (10, 0), (10, 10)], [(0, 0.004), (10, 10)]])  # meets in centimetres
    got = _rings(spark, rows)
    assert got[1, "outer", 0] == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert got[3, "outer", 0] == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)] and got[3, "inner", 1] == [(3, 3), (4, 3), (4, 4), (3, 3)]
    assert got[4, "outer", 0] == [(0, 0), (5, 0), (5, 5), (0, 5), (0, 0)] and got[4, "outer", 2] == [(5, 5), (9, 5), (9, 9), (5, 9), (5, 5)]
    assert got[6, "outer", 0] == [(0, 0), (10, 0), (10, 10), (0, 0)]
    assert set(got) == {(1, "outer", 0), (3, "outer", 0), (3, "inner", 1), (4, "outer", 0), (4, "outer", 2), (6, "outer", 0)}


def test_long_ring_of_many_lines(spark):
    n = 600
    corner = lambda i: (100 * math.cos(2 * math.pi * i / n), 100 * math.sin(2 * math.pi * i / n))
    lines = [[corner(i), corner((i + 1) % n)][:: 1 if i % 3 else -1] for i in range(n)]
    random.Random(1).shuffle(lines)
    got = _rings(spark, _pieces(1, "outer", lines))
    assert list(got) == [(1, "outer", 0)] and len(got[1, "outer", 0]) == n + 1


def test_yards_find_their_outer(spark):
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    parts = [(0, "outer", box(0, 0, 100)), (1, "outer", box(200, 0, 100)), (2, "inner", box(230, 30, 9)), (3, "inner", box(500, 0, 5)), (4, "inner", [(-5, 50), (-5, 40), (10, 40), (10, 50), (-5, 50)])]
    rows = [(1, role, ring, i, float(x), float(y)) for ring, role, line in parts for i, (x, y) in enumerate(line, 1)]
    rows += [(2, "inner", 9, i, float(x), float(y)) for i, (x, y) in enumerate(box(0, 0, 3), 1)]
    got = rings.holes_in_outers(spark.createDataFrame(rows, "element long, role string, ring long, seq int, x double, y double")).collect()
    assert {(r.element, r.hole): r.outer for r in got} == {(1, 2): 1, (1, 3): None, (1, 4): 0, (2, 9): None}


def _filled(corners, rows, cols):
    edges = [(a, b) for ring in corners for a, b in zip(ring, [*ring[1:], ring[0]]) if a[0] == b[0]]
    inside = lambda r, c: sum(x > c + 0.5 and min(y0, y1) <= r < max(y0, y1) for (x, y0), (_, y1) in edges) % 2 == 1
    return {(r, c) for r in range(rows) for c in range(cols) if inside(r, c)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rings_fill_to_their_mask(spark, seed):
    draw = random.Random(seed)
    cells = {(r, c) for r in range(20) for c in range(24) if draw.random() < [0.55, 0.8][seed % 2]}
    found = {}
    areas = {}
    for r in sorted(rings.mask_rings(spark.createDataFrame(sorted(cells), "row int, col int"), 1).collect(), key=lambda r: r.seq):
        found.setdefault(r.ring, []).append((r.x, r.y))
        areas[r.ring] = r.area
    assert _filled(found.values(), 20, 24) == cells and sum(areas.values()) == len(cells)
    for ring, corners in found.items():
        assert sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]])) / 2 == areas[ring]


def test_small_components_go_and_corners_keep_apart(spark):
    cells = [(0, 0), (0, 1), (1, 0), (2, 1), (2, 2), (3, 1), (9, 9), (9, 10)]
    got = rings.mask_rings(spark.createDataFrame(cells, "row int, col int")).collect()
    assert {(r.component.row, r.component.col) for r in got} == {(0, 0), (2, 1)} and {r.area for r in got} == {3.0}
    assert rings.mask_rings(spark.createDataFrame([], "row int, col int")).count() == 0


def _simple(points, tolerance):
    n = len(points)
    if n <= 4:
        return points
    far = max(range(1, n), key=lambda i: (math.hypot(points[i][0] - points[0][0], points[i][1] - points[0][1]), -i))
    keep, todo = {0, far}, [(0, far), (far, n)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = points[a], points[b % n]
        ex, ey, worst, most = bx - ax, by - ay, None, tolerance
        for i in range(a + 1, b):
            px, py = points[i]
            d = abs((px - ax) * ey - (py - ay) * ex) / math.hypot(ex, ey) if ex or ey else math.hypot(px - ax, py - ay)
            if d > most:
                worst, most = i, d
        if worst is not None:
            keep.add(worst)
            todo += [(a, worst), (worst, b)]
    return [p for i, p in enumerate(points) if i in keep]


def test_rings_are_simplified(spark):
    draw = random.Random(4)
    shapes = {k: [((20 + draw.random() * 6) * math.cos(i / n * 6.28), (20 + draw.random() * 6) * math.sin(i / n * 6.28)) for i in range(n)] for k, n in enumerate([3, 4, 5, 40, 150])}
    rows = [(k, i + 1, *p, "kept") for k, ps in shapes.items() for i, p in enumerate(ps)]
    got = {}
    for r in sorted(rings.simplified(spark.createDataFrame(rows, "ring int, seq int, x double, y double, more string"), 2.0, ["ring"]).collect(), key=lambda r: r.seq):
        got.setdefault(r.ring, []).append((r.x, r.y))
        assert r.more == "kept"
    assert got == {k: _simple(ps, 2.0) for k, ps in shapes.items()}


def test_holes_take_the_nearest_value(spark):
    draw = random.Random(6)
    for share in (0.02, 0.3, 1.0):
        known = {(r, c): float(r * 100 + c) for r in range(17) for c in range(23) if draw.random() < share}
        want, queue = dict(known), deque(sorted(known))
        while queue:
            r, c = queue.popleft()
            for at in ((r, c - 1), (r, c + 1), (r - 1, c), (r + 1, c)):
                if at not in want and 0 <= at[0] < 17 and 0 <= at[1] < 23:
                    want[at] = want[r, c]
                    queue.append(at)
        rows = [(1, r, c, known.get((r, c), [None, math.nan][(r + c) % 2])) for r in range(17) for c in range(23)] + [(2, 0, 0, None)]
        got = rasters.nearest_filled(spark.createDataFrame(rows, "grid int, row int, col int, value double"), ["grid"]).collect()
        assert {(r.row, r.col): r.value for r in got if r.grid == 1} == want
        assert [r.value for r in got if r.grid == 2] == [None]


def test_tables_are_composed_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(automata, "BLOCK", 4)
    draw = random.Random(3)
    rows, want = [], {}
    for key, n in enumerate([1, 3, 4, 5, 90]):
        state = 1
        for p in range(n):
            table = None if draw.random() < 0.2 else [draw.randrange(3) for _ in range(3)]
            after = state if table is None else table[state]
            want[key, p] = (state, after)
            rows.append((key, p, table))
            state = after
    got = automata.folded(spark.createDataFrame(rows, "key int, p long, moves array<int>"), ["key"], "p", "moves", 1).collect()
    assert {(r.key, r.p): (r.before, r.after) for r in got} == want and len(got) == len(rows)


def test_sides_are_kept_for_small_gains(spark):
    rows = [(0, 0.5, 0.4, "a"), (1, 0.4, 0.5, "a"), (2, 0.2, 0.5, "a"), (3, 0.5, 0.45, "b"), (4, None, 0.9, "b"), (5, None, None, "b"), (6, 0.3, 0.3, "b"), (7, 0.3, 0.2, None), (8, 0.1, 0.0, None)]
    got = automata.chosen_sides(spark.createDataFrame([(1, *r) for r in rows], "route int, p long, left double, right double, street string"), ["route"], "p").collect()
    assert [r.side for r in sorted(got, key=lambda r: r.p)] == ["R", "R", "L", "R", "R", None, "L", "R", "R"]


def test_shortest_paths_raise_when_rounds_run_out(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)], "src long, dst long, cost double")
    start = spark.createDataFrame([(0,)], "node long")
    with pytest.raises(RuntimeError):
        graph.shortest_paths(chain, start, 3)
    assert {r.node: r.cost for r in graph.shortest_paths(chain, start).collect()} == {i: float(i) for i in range(13)}


def test_cycles_followed_by_parts_equal_joined(spark):
    """Rings of 1, 2, 7 and 40 items, a list with an end, in tasks that follow a few links at once; the joined way needs a round for each doubling."""
    random.seed(5)
    names = list(range(60))
    random.shuffle(names)
    links, at = [], 0
    for size in (1, 2, 7, 40):
        ring, at = names[at : at + size], at + size
        links += [(a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
    links += [(a, b) for a, b in zip(names[at:], names[at + 1 :])]
    frame = spark.createDataFrame(links, "a long, b long").selectExpr("struct(a div 10 AS of, a) AS item", "struct(b div 10 AS of, b AS a) AS next")
    plain = lambda found: sorted((r.item.a, r.ring.a, r.place) for r in found.collect())
    want = plain(chains.cycles(frame))
    assert len(want) == 50
    for at_once in (3, 1000):
        for near in (lambda item: [item["of"]], lambda item: [F.lit(1)]):
            assert plain(chains.cycles(frame, near, at_once=at_once)) == want


def test_masks_are_the_same_across_tiles(spark, monkeypatch):
    """A mask that lies across four tiles gives what it gives within one; only cells at the rims of tiles are joined by star contraction."""
    draw = random.Random(11)
    cells = {(r, c) for r in range(40) for c in range(40) if draw.random() < 0.6} | {(20, c) for c in range(120)} | {(r, c) for r in (0, 60) for c in range(61)} | {(r, c) for r in range(61) for c in (0, 60)}
    joined, real = [], rings.connected_components
    monkeypatch.setattr(rings, "connected_components", lambda edges: joined.append(edges.count()) or real(edges))

    def found(dy, dx, least):
        frame = spark.createDataFrame([(r + dy, c + dx) for r, c in sorted(cells)] * 2, "row int, col int")
        return sorted((r.component.row - dy, r.component.col - dx, r.ring.y - dy, r.ring.x - dx, r.ring.dir, r.seq, r.x - dx, r.y - dy, r.area) for r in rings.mask_rings(frame, least).collect())

    for least in (1, 3):
        assert found(rings.TILE - 20, -25, least) == found(1, 1, least)
    assert joined[1] == joined[3] == 0 and 0 < joined[0] < 150 < len(cells)
