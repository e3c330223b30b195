"""Queries of steps: sides, tiny groups and turns along the events of each user."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.operators import automata
from umbra.plans.registry import query

_ORDERED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events"


def _ordered(read):
    return read("events").withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1)


@query("win_13_sides", f"""WITH RECURSIVE p AS MATERIALIZED (SELECT user_id, event_id, i, CASE WHEN event_id % 9 > 0 THEN event_id * 7 % 100 / 100.0 END::DOUBLE AS l, CASE WHEN event_id % 9 > 1 THEN event_id * 13 % 100 / 100.0 END::DOUBLE AS r,
        coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY i) = event_type, false) AS same FROM ({_ORDERED})),
    w AS (SELECT user_id, event_id, i, CASE WHEN l IS NULL AND r IS NULL THEN NULL WHEN r IS NULL OR l <= r THEN 'L' ELSE 'R' END AS side FROM p WHERE i = 0
        UNION ALL SELECT p.user_id, p.event_id, p.i, CASE WHEN same AND w.side = 'L' AND l <= least(l, r) + 0.15::DOUBLE THEN 'L' WHEN same AND w.side = 'R' AND r <= least(l, r) + 0.15::DOUBLE THEN 'R'
            WHEN l IS NULL AND r IS NULL THEN NULL WHEN r IS NULL OR l <= r THEN 'L' ELSE 'R' END FROM w JOIN p ON p.user_id = w.user_id AND p.i = w.i + 1)
    SELECT event_id, side FROM w""")
def _(read):
    left = F.when(F.col("event_id") % 9 > 0, F.col("event_id") * 7 % 100 / 100.0)
    right = F.when(F.col("event_id") % 9 > 1, F.col("event_id") * 13 % 100 / 100.0)
    pieces = _ordered(read).select("user_id", "event_id", "i", left.alias("left"), right.alias("right"), F.col("event_type").alias("street"))
    return automata.chosen_sides(pieces, ["user_id"], "i").select("event_id", "side")


_GROUPS = f"""SELECT user_id, i, CASE WHEN event_id % 6 = 0 THEN 'stairs' ELSE 'walk' END AS kind, event_id * 7 % 3 AS name, sum(event_id * 11 % 17) OVER w - event_id * 11 % 17 AS from_m, sum(event_id * 11 % 17) OVER w AS to_m
    FROM ({_ORDERED}) WINDOW w AS (PARTITION BY user_id ORDER BY i)"""


@query("win_06_absorbed", f"""WITH RECURSIVE g AS MATERIALIZED (SELECT *, kind = 'walk' AS walks, lead(kind) OVER w = 'walk' AS next_walks, count(*) OVER (PARTITION BY user_id) AS n FROM ({_GROUPS}) WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    m AS (SELECT user_id, -1::BIGINT AS i, NULL::BIGINT AS head, NULL::BIGINT AS head_name, false AS head_walks, NULL::BIGINT AS pending, NULL::BIGINT AS begun, NULL::BIGINT AS until FROM g WHERE i = 0
        UNION ALL SELECT user_id, i, CASE WHEN joins THEN head WHEN waits THEN head ELSE i END, CASE WHEN joins OR waits THEN head_name ELSE name END, CASE WHEN joins OR waits THEN head_walks ELSE walks END,
            CASE WHEN waits THEN start END, CASE WHEN NOT joins AND NOT waits THEN start END, CASE WHEN NOT waits THEN to_m END FROM (
            SELECT *, head_walks AND (tiny OR (walks AND name = head_name)) AS joins, NOT head_walks AND tiny AND next_walks AS waits FROM (
                SELECT g.user_id, g.i, g.name, g.walks, coalesce(g.next_walks, false) AS next_walks, g.to_m, m.head, m.head_name, m.head_walks, coalesce(m.pending, g.from_m) AS start,
                    g.walks AND g.to_m - coalesce(m.pending, g.from_m) < 8 AND g.n > 1 AS tiny FROM m JOIN g ON g.user_id = m.user_id AND g.i = m.i + 1)))
    SELECT user_id, head, max(begun)::BIGINT AS from_m, max(until)::BIGINT AS to_m FROM m WHERE until IS NOT NULL GROUP BY 1, 2""")
def _(read):
    length = F.col("event_id") * 11 % 17
    end = F.sum(length).over(W.partitionBy("user_id").orderBy("i"))
    kind = F.when(F.col("event_id") % 6 == 0, "stairs").otherwise("walk")
    groups = _ordered(read).select("user_id", "i", kind.alias("kind"), (F.col("event_id") * 7 % 3).alias("name"), (end - length).alias("from_m"), end.alias("to_m"))
    return automata.absorbed(groups, ["user_id"], "i").select("user_id", "head", "from_m", "to_m")


@query("win_07_spaced_cuts", f"""WITH RECURSIVE p AS MATERIALIZED (SELECT user_id, i, at_m, abs(angle) AS a, max(at_m) OVER (PARTITION BY user_id) - at_m >= 15 AS far FROM (SELECT user_id, i, event_id * 37 % 361 - 180 AS angle,
        sum((event_id % 5 + 1) * 1.5::DOUBLE) OVER (PARTITION BY user_id ORDER BY i) AS at_m FROM ({_ORDERED}))),
    s AS (SELECT user_id, -1::BIGINT AS i, 0.0::DOUBLE AS cut_m, NULL::DOUBLE AS begun, NULL::DOUBLE AS best_m, NULL::BIGINT AS best_a, NULL::BIGINT AS best, NULL::BIGINT AS cut FROM p WHERE i = 0
        UNION ALL SELECT user_id, i, cut_m, CASE WHEN inside THEN begun WHEN opens THEN at_m END, CASE WHEN inside AND NOT better THEN best_m WHEN inside OR opens THEN at_m END,
            CASE WHEN inside AND NOT better THEN best_a WHEN inside OR opens THEN a END, CASE WHEN inside AND NOT better THEN best WHEN inside OR opens THEN i END, cut FROM (
            SELECT *, inside AND far AND a > best_a AS better, NOT inside AND at_m - cut_m >= 15 AND far AND a >= 50 AS opens FROM (
                SELECT p.user_id, p.i, p.at_m, p.a, p.far, s.begun, s.best_m, s.best_a, s.best, coalesce(p.at_m - s.begun < 15, false) AS inside,
                    CASE WHEN p.at_m - s.begun >= 15 THEN s.best END AS cut, CASE WHEN p.at_m - s.begun >= 15 THEN s.best_m ELSE s.cut_m END AS cut_m FROM s JOIN p ON p.user_id = s.user_id AND p.i = s.i + 1)))
    SELECT user_id, cut AS i FROM s WHERE cut IS NOT NULL UNION ALL SELECT user_id, arg_max(coalesce(best, -1), i) AS i FROM s GROUP BY 1 HAVING arg_max(coalesce(best, -1), i) >= 0""")
def _(read):
    at = F.sum((F.col("event_id") % 5 + 1) * 1.5).over(W.partitionBy("user_id").orderBy("i"))
    points = _ordered(read).select("user_id", "i", at.alias("at_m"), (F.col("event_id") * 37 % 361 - 180).alias("angle"))
    points = points.withColumns({"begin_m": F.lit(0.0), "end_m": F.max("at_m").over(W.partitionBy("user_id"))})
    return automata.spaced_cuts(points, ["user_id"], "i")
