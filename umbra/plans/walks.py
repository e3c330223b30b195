"""Queries of the tag rules, of operators along routes and of rasters, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import geo, tags
from umbra.operators import rasters, routes
from umbra.plans.registry import NODES, RASTER, nodes, query, raster, stand_in

M, LM = f"({geo.METRES_PER_DEGREE!r})", f"({geo.LON_METRES!r})"

# --- stand-ins: tagged things from parts, segments of routes from line items, options from orders ----------------
TAGGED = """SELECT p_partkey AS id, p_size, CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'private' WHEN 3 THEN 'discouraged' END AS foot,
    CASE p_partkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS access, CASE p_partkey % 7 WHEN 0 THEN 'gate' WHEN 1 THEN 'no' WHEN 2 THEN 'bollard' END AS barrier,
    CASE p_partkey % 2 WHEN 0 THEN 'yes' END AS locked, CASE p_partkey % 4 WHEN 0 THEN 'traffic_signals' WHEN 1 THEN 'footway' WHEN 2 THEN '' END AS highway,
    CASE p_partkey % 11 WHEN 0 THEN 'marked; Toucan' WHEN 1 THEN 'no' WHEN 2 THEN 'zebra' END AS crossing, CASE p_partkey % 13 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS lights,
    CASE p_partkey % 6 WHEN 0 THEN p_size || ' mm' WHEN 1 THEN p_size || 'cm' WHEN 2 THEN '0,0' || p_size WHEN 3 THEN 'high' END AS kerb_height,
    CASE p_partkey % 2 WHEN 1 THEN 'raised' END AS kerb, CASE p_partkey % 9 WHEN 0 THEN 'deciduous' WHEN 1 THEN 'evergreen' END AS cycle,
    CASE p_partkey % 8 WHEN 0 THEN 'Larix decidua' WHEN 1 THEN 'Picea abies' WHEN 2 THEN 'Cisowiec' WHEN 3 THEN 'Żywotnik' END AS species,
    CASE p_partkey % 10 WHEN 0 THEN 'needleleaved' END AS leaf, CASE p_partkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS building,
    CASE p_partkey % 8 WHEN 0 THEN 'underground' END AS location FROM part"""
KEYS = ("foot", "access", "barrier", "locked", "highway", "crossing", "kerb", "species", "building", "location")
NAMED = {"crossing:signals": "lights", "kerb:height": "kerb_height", "leaf_cycle": "cycle", "leaf_type": "leaf", "bridge": "building", "tunnel": "building"}
OPTIONS = """SELECT o_custkey AS part, o_orderkey AS id, o_orderkey % 11 / 10.0::DOUBLE AS shade, o_orderkey % 7 / 6.0::DOUBLE AS sun_factor,
    CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 60 - 15.0 END AS felt, 100.0 + o_orderkey % 900 AS distance_m FROM orders"""


def tagged(read) -> DataFrame:
    rows = stand_in(read, "part", TAGGED)
    pairs = {k: k for k in KEYS} | NAMED
    return rows.select("id", F.create_map(*(x for k, c in pairs.items() for x in (F.lit(k), F.col(c)))).alias("tags"))


def segments(read) -> DataFrame:
    """Segments of routes; rows that share a line number are told apart by what they ship."""
    return read("lineitem").select(
        F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("seq"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("length_m"),
        (F.col("l_discount").cast("double") * 10).alias("sun"),
    )


def _rule(name: str, rule, sql: str) -> None:
    query(name, f"SELECT id, coalesce({sql}, false) AS holds FROM ({TAGGED})")(lambda read: tagged(read).select("id", rule(F.col("tags")).alias("holds")))


_ALLOWED, _BARRED = "coalesce(foot = 'yes', false)", "coalesce(access = 'no', false)"
_rule("flt_05_building", tags.is_building, "building = 'yes' AND location IS NULL")
_rule("flt_05_covered", tags.is_covered, "building = 'yes'")
_rule("flt_06_foot_access", tags.may_walk, f"highway IN ('traffic_signals', 'footway') AND NOT coalesce(foot IN ('no', 'private', 'discouraged'), false) AND ({_ALLOWED} OR NOT {_BARRED})")
_rule("flt_07_blocked", tags.is_blocked, f"barrier IN ('gate', 'bollard') AND NOT {_ALLOWED} AND (coalesce(foot IN ('no', 'private'), false) OR CASE WHEN access IS NULL THEN locked = 'yes' ELSE {_BARRED} END)")
_rule("flt_08_signals", tags.has_signals, "CASE lights WHEN 'yes' THEN true WHEN 'no' THEN false ELSE coalesce(crossing = 'marked; Toucan', false) OR (highway = 'traffic_signals' AND coalesce(crossing, '') <> 'no') END")
_KERB = "CASE id % 6 WHEN 0 THEN p_size / 1000.0 WHEN 1 THEN p_size / 100.0 WHEN 2 THEN ('0.0' || p_size)::DOUBLE END"
_rule("flt_09_raised_kerb", tags.is_raised, f"coalesce({_KERB} > 0.03, kerb = 'raised')")
_rule("flt_10_evergreen", tags.keeps_leaves, "CASE cycle WHEN 'deciduous' THEN false WHEN 'evergreen' THEN true ELSE CASE WHEN id % 8 = 0 THEN false ELSE leaf = 'needleleaved' OR coalesce(id % 8 IN (1, 3), false) END END")
_rule("flt_11_bridge", tags.is_bridge, "building = 'yes'")


@query("flt_15_cloud_bits", "SELECT event_id, (event_id & 31) = 0 AS clear FROM events")
def _(read):
    return read("events").select("event_id", (F.col("event_id").bitwiseAND(31) == 0).alias("clear"))


def _ends() -> tuple[Column, Column, Column, Column]:
    key = F.col("c_custkey")
    return (key * 37 % 9000).cast("double"), (key * 11 % 5000).cast("double"), (key * 17 % 7000).cast("double"), (key * 53 % 8000).cast("double")


@query("flt_24_routing_box", f"""SELECT id, round((least(x0, x1) - g) / {LM} + 19.9372, 6) AS west, round((greatest(y0, y1) + g) / {M} + 50.0614, 6) AS north,
    round((greatest(x0, x1) + g) / {LM} + 19.9372, 6) AS east, round((least(y0, y1) - g) / {M} + 50.0614, 6) AS south FROM (
    SELECT *, greatest(450.0, least(900.0, 0.3 * d)) AS g FROM (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS d FROM (
    SELECT c_custkey AS id, (c_custkey * 37 % 9000)::DOUBLE AS x0, (c_custkey * 11 % 5000)::DOUBLE AS y0, (c_custkey * 17 % 7000)::DOUBLE AS x1, (c_custkey * 53 % 8000)::DOUBLE AS y1 FROM customer)) WHERE d <= 8000)""")
def _(read):
    return routes.routing_box(read("customer"), *_ends()).select(F.col("c_custkey").alias("id"), *(F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")))


_LINE = f"""SELECT way_id, seq, x, y, sum(s) OVER (PARTITION BY way_id ORDER BY seq) AS cum FROM (
    SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS s FROM ({NODES}) WINDOW w AS (PARTITION BY way_id ORDER BY seq))"""


@query("win_02_point_at", f"""WITH l AS ({_LINE}), e AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(cum) OVER w AS cum1 FROM l WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
    q AS (SELECT DISTINCT way_id, way_id % 700 * 10.5 AS want FROM l), b AS (SELECT q.way_id, q.want, arg_max(e, e.seq) AS e FROM q JOIN e ON q.way_id = e.way_id AND e.cum <= q.want GROUP BY ALL)
    SELECT way_id, round(e.x + coalesce((e.x1 - e.x) * f, 0), 4) AS x, round(e.y + coalesce((e.y1 - e.y) * f, 0), 4) AS y FROM (SELECT *, CASE WHEN e.cum1 > e.cum THEN (want - e.cum) / (e.cum1 - e.cum) ELSE 0 END AS f FROM b)""")
def _(read):
    points = nodes(read)
    wanted = points.select("way_id").distinct().withColumn("at", F.col("way_id") % 700 * 10.5)
    return routes.points_at(points, wanted, "way_id", ["seq"]).select("way_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("win_04_maneuver", """SELECT event_id, CASE WHEN b < 25 THEN 'continue' WHEN b >= 165 THEN 'uturn' WHEN b < 50 THEN 'slight_' || s WHEN b < 125 THEN s ELSE 'sharp_' || s END AS turn
    FROM (SELECT event_id, abs(event_id % 361 - 180) AS b, CASE WHEN event_id % 361 > 180 THEN 'right' ELSE 'left' END AS s FROM events)""")
def _(read):
    return read("events").select("event_id", routes.maneuver(F.col("event_id") % 361 - 180).alias("turn"))


@query("win_10_pieces", """SELECT p_partkey, k::INT AS piece, length_m / n AS piece_m FROM (SELECT *, unnest(range(n)) AS k FROM (
    SELECT p_partkey, p_size * 7.0::DOUBLE AS length_m, ceil(p_size * 7.0::DOUBLE / 60)::INT AS n FROM part))""")
def _(read):
    return routes.pieces(read("part").select("p_partkey", (F.col("p_size") * F.lit(7.0)).alias("length_m"))).select("p_partkey", "piece", "piece_m")


@query("win_12_transitions", """SELECT user_id, count(*) FILTER (WHERE event_type = 'click' AND event_type IS DISTINCT FROM before) AS n FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1""")
def _(read):
    return routes.entries(read("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type"))


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity"
_RANGES = f"""SELECT route, seq, l_partkey, l_suppkey, sun, (s - length_m) * 1000.0 / t AS start_m, s * 1000.0 / t AS end_m FROM (
    SELECT l_orderkey AS route, l_linenumber AS seq, l_partkey, l_suppkey, l_discount::DOUBLE * 10 AS sun, l_quantity::DOUBLE AS length_m,
    sum(l_quantity::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS s, sum(l_quantity::DOUBLE) OVER (PARTITION BY l_orderkey) AS t FROM lineitem)"""


def _ranges(read) -> DataFrame:
    return routes.segment_ranges(segments(read).withColumn("total", F.lit(1000.0)), "route", ["seq", "l_partkey", "l_suppkey", "length_m"], "length_m", "total")


@query("win_17_ranges", f"SELECT route, seq, l_partkey, l_suppkey, round(start_m, 6) AS start_m, round(end_m, 6) AS end_m FROM ({_RANGES})")
def _(read):
    return _ranges(read).select("route", "seq", "l_partkey", "l_suppkey", F.round("start_m", 6).alias("start_m"), F.round("end_m", 6).alias("end_m"))


# Shares that lie halfway between two roundings are pushed up by far less than a digit: sums of doubles depend on their order.
@query("agg_23_shade_ahead", f"""SELECT route, round(sum(a * (1 - least(1.0, sun))) / sum(a) + 1e-9, 6) AS shade_ahead FROM (
    SELECT route, sun, end_m - greatest(start_m, 400.0) AS a FROM ({_RANGES})) WHERE a > 1e-6 GROUP BY 1""")
def _(read):
    return routes.shade_ahead(_ranges(read), "route", F.lit(400.0), "sun").withColumn("shade_ahead", F.round(F.col("shade_ahead") + 1e-9, 6))


@query("agg_21_main_streets", """SELECT route, name, floor(m + 0.5) AS m, floor(100 * (1 - s / m) + 0.5) AS shade_pct FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY m DESC, name) AS k FROM (
    SELECT l_suppkey AS route, 'street ' || l_partkey % 12 AS name, sum(l_quantity::DOUBLE) AS m, sum(l_quantity::DOUBLE * l_linenumber / 8) AS s FROM lineitem GROUP BY 1, 2)) WHERE k <= 6""")
def _(read):
    rows = read("lineitem").select(F.col("l_suppkey").alias("route"), F.concat(F.lit("street "), F.col("l_partkey") % 12).alias("name"), F.col("l_quantity").cast("double").alias("length_m"), (F.col("l_linenumber") / 8).alias("sun"))
    return routes.main_streets(rows, "route")


@query("win_21_departures", """SELECT o_orderkey, k * step AS offset_min, o_orderdate::TIMESTAMP + to_minutes((k * step)::BIGINT) AS departs FROM (SELECT *, unnest(range(floor(win / step)::BIGINT + 1)) AS k FROM (
    SELECT o_orderkey, o_orderdate, win, CASE WHEN floor(win / s) + 1 > 33 THEN ceil(win / 32.0 / 15) * 15 ELSE s::DOUBLE END AS step FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 17 * 60.0::DOUBLE AS win, 15 + o_orderkey % 30 AS s FROM orders)))""")
def _(read):
    rows = read("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("start"))
    out = routes.departures(rows, "start", F.col("o_orderkey") % 17, 15 + F.col("o_orderkey") % 30)
    return out.select("o_orderkey", "offset_min", F.col("departs").cast("timestamp_ntz").alias("departs"))


_FELT = "CASE WHEN felt > 24 THEN greatest(0, 1 - (felt - 24) / 16) WHEN felt < 15 THEN greatest(0, 1 - (15 - felt) / 25) ELSE 1 END"


@query("agg_22_departure_scores", f"""SELECT part, id, floor(100 * CASE WHEN warm THEN s + 0.35 * c ELSE s / 0.65 END + 0.5)::BIGINT AS score FROM (SELECT *, 0.5 * (1 - least(1, greatest(0, (1 - shade) * sun_factor))) + 0.15 * near AS s, {_FELT} AS c FROM (
    SELECT part, id, shade::DOUBLE AS shade, sun_factor::DOUBLE AS sun_factor, felt::DOUBLE AS felt, min(distance_m::DOUBLE) OVER w / distance_m::DOUBLE AS near, bool_and(felt IS NOT NULL) OVER w AS warm FROM ({OPTIONS}) WINDOW w AS (PARTITION BY part)))""")
def _(read):
    rows = stand_in(read, "orders", OPTIONS)
    doubles = [F.col(c).cast("double").alias(c) for c in ("shade", "sun_factor", "felt", "distance_m")]
    return routes.score_departures(rows.select("part", "id", *doubles), "part").select("part", "id", "score")


@query("agg_32_smoothed", """SELECT user_id, round(sum(value * 0.5 ** least(b, n - 1)), 6) AS mean FROM (
    SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def _(read):
    return routes.smoothed(read("events"), "user_id", ["ts", "event_id"], "value").withColumn("mean", F.round("mean", 6))


@query("win_20_dilate", f"""WITH s AS (SELECT DISTINCT "row" AS r, "col" AS q FROM ({RASTER}) WHERE value > 0.3)
    SELECT DISTINCT r + i AS "row", q + j AS "col" FROM s, (SELECT unnest(range(-3, 4)) AS i) a, (SELECT unnest(range(-3, 4)) AS j) b WHERE r + i BETWEEN 0 AND (SELECT max("row") FROM ({RASTER})) AND q + j BETWEEN 0 AND 63""")
def _(read):
    rows = (read("embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1
    found = rasters.dilate(raster(read).where("value > 0.3"), 3, rows, 64)
    return found.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query("win_20_dilate_whole", f"""WITH g AS (FROM ({RASTER})), s AS (SELECT DISTINCT "row" AS r, "col" AS q FROM g WHERE value > 0.3), m AS (SELECT max("row") AS last FROM g)
    SELECT DISTINCT r + i AS "row", q + j AS "col" FROM s, m, (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS j) b WHERE r + i BETWEEN 0 AND last AND q + j BETWEEN 0 AND 63""")
def _(read):
    rows = (read("embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1
    found = rasters.dilate(raster(read).where("value > 0.3"), 2, rows, 64)
    return found.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query("jon_12_in_rings", """SELECT pid, rid FROM (SELECT c_custkey AS pid, c_custkey * 13 % 950 + 0.25 AS px, c_custkey * 29 % 950 + 0.5 AS py FROM customer)
    JOIN (SELECT s_suppkey AS rid, s_suppkey * 37 % 900 AS mx, s_suppkey * 91 % 900 AS my, 20 + s_suppkey % 30 AS w FROM supplier) ON abs(px - mx) + abs(py - my) < w""")
def _(read):
    points = stand_in(read, "customer", "SELECT c_custkey AS pid, c_custkey * 13 % 950 + 0.25 AS px, c_custkey * 29 % 950 + 0.5 AS py FROM customer")
    mid = stand_in(read, "supplier", "SELECT s_suppkey AS rid, s_suppkey * 37 % 900 AS mx, s_suppkey * 91 % 900 AS my, 20 + s_suppkey % 30 AS w FROM supplier")
    corner = lambda dx, dy: F.struct((F.col("mx") + dx * F.col("w")).cast("double").alias("x"), (F.col("my") + dy * F.col("w")).cast("double").alias("y"))
    rings = mid.select("rid", F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1)).alias("ring"))
    return rasters.in_rings(points.withColumn("px", F.col("px").cast("double")).withColumn("py", F.col("py").cast("double")), rings, 60.0)


@query("jon_19_difference", f"""SELECT a."row", a."col", round(a.value - b.value, 6) AS value FROM ({RASTER}) a JOIN (SELECT "row" + 1 AS "row", "col", value FROM ({RASTER})) b USING ("row", "col")""")
def _(read):
    upper = raster(read)
    return rasters.difference(upper, upper.withColumn("row", F.col("row") + 1)).withColumn("value", F.round("value", 6))


@query("jon_25_outside_coverage", f"""SELECT c_custkey AS id FROM customer WHERE (c_custkey % 90, c_custkey % 64) NOT IN (SELECT ("row", "col") FROM ({RASTER}) WHERE value > 0)""")
def _(read):
    points = read("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 64 * 2.0).alias("px"), (F.col("c_custkey") % 90 * 2.0).alias("py"))
    return rasters.outside_coverage(points, raster(read).where("value > 0"), 2.0).select("id")


@query("agg_26_composite", f"""WITH s AS (SELECT "row" % 5 AS scene, "row" // 5 AS r, "col" AS q, value AS v FROM ({RASTER})), m AS (SELECT scene, median(v) AS mid FROM s GROUP BY 1)
    SELECT r AS "row", q AS "col", round(median(v - mid) + (SELECT avg(mid) FROM m), 6) AS value FROM s JOIN m USING (scene) GROUP BY 1, 2""")
def _(read):
    scenes = raster(read).select((F.col("row") % 5).alias("scene"), F.floor(F.col("row") / 5).alias("row"), "col", "value")
    return rasters.composite(scenes).withColumn("value", F.round("value", 6))


@query("agg_27_grid_statistics", f"SELECT round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS low, max(value) AS high FROM ({RASTER})")
def _(read):
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = raster(read).agg(q.alias("q"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(*(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))), "low", "high")


@query("agg_28_coverage", f"""SELECT "row" // 8 AS block, count(*) FILTER (WHERE value > 0) / count(*) AS share FROM ({RASTER}) GROUP BY 1""")
def _(read):
    return raster(read).groupBy(F.floor(F.col("row") / 8).alias("block")).agg((F.count_if(F.col("value") > 0) / F.count(F.lit(1))).alias("share"))
