"""Registry of the engine's queries over the supplied tables and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import geo, text, times
from umbra.operators import graph, sequences, spatial
from umbra.plans import ahead, clocks, lines, rings, scenes, search, sessions, steps, tiles, unions, walks, ways  # noqa: F401  (register their queries)
from umbra.plans.registry import FIXES, NODES, ORACLES, POIS, QUERIES, RASTER, SEGMENTS, WALKERS, fixes, nodes, pois, query, raster, stand_in

M = f"({geo.METRES_PER_DEGREE!r})"
LM = f"({geo.LON_METRES!r})"
_R = "floor(({0}) * {1} + 0.5) / {1}"


@query("prj_01_local_metres", f"SELECT id, {_R.format(f'(lon - 19.9372) * {LM}', '100.0')} AS x, {_R.format(f'(lat - 50.0614) * {M}', '100.0')} AS y FROM ({POIS})")
def _(read):
    x, y = geo.to_xy(F.col("lat"), F.col("lon"))
    return pois(read).select("id", geo.rounded(x, 2).alias("x"), geo.rounded(y, 2).alias("y"))


@query("prj_02_degrees", f"SELECT id, {_R.format(f'id * 0.5 / {M} + 50.0614', '1e6')} AS lat, {_R.format(f'id * 0.25 / {LM} + 19.9372', '1e6')} AS lon FROM ({POIS})")
def _(read):
    lat, lon = geo.to_lat_lon(F.col("id") * 0.25, F.col("id") * 0.5)
    return pois(read).select("id", geo.rounded(lat, 6).alias("lat"), geo.rounded(lon, 6).alias("lon"))


@query("prj_07_tile_counts", f"SELECT floor(lon / 0.03 + 1e-9)::BIGINT AS ix, floor(lat / 0.02 + 1e-9)::BIGINT AS iy, count(*) AS n FROM ({POIS}) GROUP BY ALL")
def _(read):
    ix, iy = geo.tile_of(F.col("lat"), F.col("lon"))
    return pois(read).groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_01_bbox_kinds", f"SELECT id, kind FROM ({POIS}) WHERE lon BETWEEN 19.9 AND 20.0 AND lat BETWEEN 50.0 AND 50.1 AND kind IN ('BUILDING', 'MACHINERY')")
def _(read):
    return pois(read).where(F.col("lon").between(19.9, 20.0) & F.col("lat").between(50.0, 50.1) & F.col("kind").isin("BUILDING", "MACHINERY")).select("id", "kind")


@query("flt_02_service_area", f"SELECT count(*) AS n FROM ({POIS}) WHERE lon BETWEEN 19.78 AND 20.22 AND lat BETWEEN 49.96 AND 50.13")
def _(read):
    return pois(read).where(geo.in_area(F.col("lat"), F.col("lon"))).agg(F.count(F.lit(1)).alias("n"))


@query("flt_12_leaf_off", "SELECT o_orderkey, month(o_orderdate) >= 11 OR month(o_orderdate) <= 3 OR (month(o_orderdate) = 4 AND day(o_orderdate) <= 10) AS leaf_off FROM orders")
def _(read):
    local = F.to_utc_timestamp(F.col("o_orderdate").cast("timestamp"), times.ZONE)
    return read("orders").select("o_orderkey", times.is_leaf_off(local).alias("leaf_off"))


@query("mth_05_bearing", f"""SELECT way_id, seq, {_R.format('((degrees(atan2(dx, dy)) + 360) % 360)', '1e6')} AS bearing, floor(((degrees(atan2(dx, dy)) + 360) % 360) / 45 + 0.5)::BIGINT % 8 AS point
    FROM (SELECT way_id, seq, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM ({NODES}) WINDOW w AS (PARTITION BY way_id ORDER BY seq)) WHERE dx IS NOT NULL""")
def _(read):
    from pyspark.sql import Window as W

    w = W.partitionBy("way_id").orderBy("seq")
    steps = nodes(read).select("way_id", "seq", (F.lead("x").over(w) - F.col("x")).alias("dx"), (F.lead("y").over(w) - F.col("y")).alias("dy")).where("dx IS NOT NULL")
    angle = geo.bearing(F.col("dx"), F.col("dy"))
    return steps.select("way_id", "seq", geo.rounded(angle, 6).alias("bearing"), geo.compass(angle).alias("point"))


@query("win_01_running_length", f"""SELECT way_id, seq, {_R.format('sum(s) OVER (PARTITION BY way_id ORDER BY seq)', '1e6')} AS cum FROM (
    SELECT way_id, seq, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS s FROM ({NODES}) WINDOW w AS (PARTITION BY way_id ORDER BY seq))""")
def _(read):
    return sequences.running_length(nodes(read), "way_id", ["seq"], "x", "y").select("way_id", "seq", geo.rounded(F.col("cum"), 6).alias("cum"))


@query("win_05_islands", f"""SELECT user_id, island, min(event_id) AS first_id, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
    SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM ({FIXES}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
    GROUP BY user_id, island""")
def _(read):
    runs = sequences.islands(fixes(read), "user_id", ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "island").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("stm_01_off_route", f"""SELECT event_id, streak, streak >= 3 AS off_route FROM (SELECT *, sum(bad) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM (
    SELECT *, (accuracy_m <= 100 AND offset_m > greatest(35.0, accuracy_m))::INT AS bad,
    sum((accuracy_m <= 100 AND NOT offset_m > greatest(35.0, accuracy_m))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM ({FIXES})))""")
def _(read):
    return sequences.strikes(fixes(read), "user_id", ["ts", "event_id"], "offset_m", "accuracy_m").select("event_id", "streak", "off_route")


@query("stm_05_tumbling", "SELECT floor(epoch_ms(ts) / 600000)::BIGINT AS slot, count(*) AS n FROM events GROUP BY 1")
def _(read):
    return read("events").groupBy(times.bucket(F.col("ts").cast("timestamp"), 10).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("stm_03_once_only", "SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2")
def _(read):
    return read("events").groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))


@query("agg_02_node_usage", f"""SELECT node_id, sum(CASE WHEN seq = lo OR seq = hi THEN 2 ELSE 1 END)::BIGINT AS usage FROM (
    SELECT *, min(seq) OVER (PARTITION BY way_id) AS lo, max(seq) OVER (PARTITION BY way_id) AS hi FROM ({NODES})) GROUP BY node_id""")
def _(read):
    return graph.node_usage(nodes(read).select("way_id", "seq", "node_id"))


@query("agg_05_percentile", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.85), 6) AS p85, round(quantile_cont(p_retailprice, 0.5), 6) AS median FROM part GROUP BY 1")
def _(read):
    return read("part").groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.85), 6).alias("p85"), F.round(F.percentile("p_retailprice", 0.5), 6).alias("median"))


@query("agg_08_roof_height", """SELECT p_brand AS building, n, CASE WHEN n >= 8 AND h BETWEEN 2 AND 150 THEN h END AS height FROM (
    SELECT p_brand, count(p_size) AS n, floor(quantile_cont(p_size::DOUBLE, 0.85) * 10 + 0.5) / 10 AS h FROM part GROUP BY 1)""")
def _(read):
    return sequences.roof_height(read("part").select(F.col("p_brand").alias("building"), F.col("p_size").cast("double").alias("size")), "building", "size")


_SHOWN = "(l_partkey * 7 % 31 * 0.4871 + l_quantity::DOUBLE * 0.1237 + 0.0113)::DOUBLE"


@query("agg_08_checked_roof", f"""WITH s AS (SELECT l_partkey AS k, {_SHOWN} AS v, l_linenumber > 2 AS inside FROM lineitem),
    t AS (SELECT k, count(*) AS n, count(*) FILTER (inside) AS ni, quantile_cont(v, 0.85) FILTER (inside) AS pi, quantile_cont(v, 0.85) AS pa, quantile_cont(v, 0.15) AS lo FROM s GROUP BY 1),
    r AS (SELECT p_partkey AS k, n, lo, floor(lo * 10 + 0.5) / 10 AS lower, floor(CASE WHEN ni >= 8 THEN pi ELSE pa END * 10 + 0.5) / 10 AS raw, p_partkey % 5 * 3.0 AS bottom, p_partkey % 20 AS ring, p_partkey % 9 AS diffs,
        p_partkey % 11 / 10.0 AS share, p_partkey % 13 AS mid, p_partkey % 4 * 0.4 AS rough FROM part LEFT JOIN t ON p_partkey = k),
    h AS (SELECT *, CASE WHEN n >= 8 AND raw BETWEEN 2 AND 150 AND raw > bottom + 0.5 THEN raw END AS roof FROM r)
    SELECT k AS building, CASE WHEN coalesce(roof BETWEEN 6 AND 40 AND n <= 200 AND ring >= 12 AND diffs >= 4 AND NOT (lo > 0.75 * roof AND share < 0.9) AND share >= 0.6 AND mid >= 0.6 * roof AND rough >= 0.6, false)
        THEN CASE WHEN lower >= 2 AND lower > bottom + 0.5 AND lower <= 0.5 * roof THEN lower END ELSE roof END AS height FROM h""")
def _(read):
    samples = read("lineitem").select(F.col("l_partkey").alias("building"), (F.col("l_partkey") * 7 % 31 * 0.4871 + F.col("l_quantity").cast("double") * 0.1237 + 0.0113).alias("value"), (F.col("l_linenumber") > 2).alias("interior"))
    k = F.col("p_partkey")
    around = [(k % 20).alias("ring_n"), (k % 9).alias("diffs_n"), (k % 11 / 10.0).alias("ring_fraction"), (k % 13).cast("double").alias("ring_median_m"), (k % 4 * 0.4).alias("roughness_m")]
    return sequences.checked_roof(samples, read("part").select(k.alias("building"), (k % 5 * 3.0).alias("bottom"), *around), "building")


@query("agg_12_block_stats", f"SELECT floor(\"row\" / 4)::BIGINT AS \"row\", floor(\"col\" / 4)::BIGINT AS \"col\", round(avg(value), 6) AS mean, max(value) AS top, count(value) AS n FROM ({RASTER}) GROUP BY 1, 2")
def _(read):
    return sequences.block_stats(raster(read), 4).withColumn("mean", F.round("mean", 6))


@query("flt_17_keep_dense", f"""WITH c AS (SELECT "row" AS r, "col" AS q FROM ({RASTER}) WHERE value > 0.1)
    SELECT a.r AS "row", a.q AS "col", count(*) AS n FROM c a JOIN c b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.q BETWEEN a.q - 1 AND a.q + 1 GROUP BY 1, 2 HAVING count(*) >= 4""")
def _(read):
    return sequences.keep_dense(raster(read).where("value > 0.1").select("row", "col"))


@query("agg_24_first_wins", """SELECT l_partkey AS id, min(l_orderkey) AS l_orderkey, bool_or(l_returnflag = 'R') AS signals FROM lineitem GROUP BY 1""")
def _(read):
    rows = read("lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey", (F.col("l_returnflag") == "R").alias("signals"))
    return sequences.first_wins(rows, "id", ["l_orderkey"], ["signals"])


@query("jon_01_semi", "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def _(read):
    return read("lineitem").join(read("part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").agg(F.count(F.lit(1)).alias("n"))


_DIST = "sqrt((x0 + t * (x1 - x0) - px) ** 2 + (y0 + t * (y1 - y0) - py) ** 2)"
_PAIRS = f"""SELECT pid, sid, {_DIST} AS dist FROM (SELECT *, greatest(0.0, least(1.0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t
    FROM ({WALKERS}) CROSS JOIN ({SEGMENTS})) WHERE {_DIST} <= 60"""


@query("jon_09_nearest_segment", f"SELECT pid, arg_min(sid, (dist, sid)) AS sid, round(min(dist), 6) AS dist FROM ({_PAIRS}) GROUP BY pid")
def _(read):
    near = spatial.nearest_segment(stand_in(read, "customer", WALKERS), stand_in(read, "supplier", SEGMENTS), 60.0)
    return near.withColumn("dist", F.round("dist", 6))


@query("jon_10_near_segments", f"SELECT pid, sid, round(dist, 6) AS dist FROM ({_PAIRS})")
def _(read):
    near = spatial.near_segments(stand_in(read, "customer", WALKERS), stand_in(read, "supplier", SEGMENTS), 60.0)
    return near.select("pid", "sid", F.round("dist", 6).alias("dist"))


@query("jon_18_asof_nearest", """WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT min(event_id) AS hour_id, ts AS hour_ts FROM events WHERE event_type <> 'purchase' GROUP BY ts)
    SELECT l.event_id, arg_min(r.hour_ts, (abs(epoch_us(l.ts) - epoch_us(r.hour_ts)), r.hour_ts)) AS hour_ts FROM l LEFT JOIN r ON abs(epoch_us(l.ts) - epoch_us(r.hour_ts)) <= 600000000 GROUP BY l.event_id""")
def _(read):
    events = read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    left = events.where("event_type = 'purchase'").select("event_id", "ts")
    right = events.where("event_type <> 'purchase'").groupBy(F.col("ts").alias("hour_ts")).agg(F.min("event_id").alias("hour_id"))
    return spatial.asof_nearest(left, right, "ts", "hour_ts", 600, "event_id").select("event_id", F.col("hour_ts").cast("timestamp_ntz").alias("hour_ts"))


@query("jon_21_bilinear", f"""WITH p AS (SELECT c_custkey AS pid, c_custkey % 40 + 0.25 AS r, c_custkey % 60 + 0.5 AS c FROM customer),
    n AS (SELECT pid, floor(r)::BIGINT + i AS "row", floor(c)::BIGINT + j AS "col", CASE WHEN i = 0 THEN 0.75 ELSE 0.25 END * 0.5 AS w FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
    SELECT pid, round(sum(value * w) / sum(w), 6) AS value FROM n JOIN ({RASTER}) USING ("row", "col") GROUP BY pid""")
def _(read):
    points = read("customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") % 40 + 0.25).alias("r"), (F.col("c_custkey") % 60 + 0.5).alias("c"))
    return spatial.bilinear(points, raster(read)).withColumn("value", F.round("value", 6))


@query("top_01_priority", f"""SELECT id, kind FROM (SELECT id, kind, CASE kind WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS p FROM ({POIS})) ORDER BY p, id LIMIT 500""")
def _(read):
    rank = F.when(F.col("kind") == "BUILDING", 0).when(F.col("kind") == "MACHINERY", 1).otherwise(2)
    return pois(read).orderBy(rank, "id").limit(500).select("id", "kind")


@query("top_03_nearest_three", f"SELECT pid, sid FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, sid) AS k FROM ({_PAIRS})) WHERE k <= 3")
def _(read):
    return spatial.nearest_segments(stand_in(read, "customer", WALKERS), stand_in(read, "supplier", SEGMENTS), 60.0, 3).select("pid", "sid")


@query("top_05_argmax", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS best FROM events GROUP BY 1")
def _(read):
    return read("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


@query("gra_01_cut_ways", f"""WITH n AS ({NODES}), u AS (SELECT node_id FROM (SELECT *, min(seq) OVER (PARTITION BY way_id) AS lo, max(seq) OVER (PARTITION BY way_id) AS hi FROM n) GROUP BY node_id HAVING sum(CASE WHEN seq = lo OR seq = hi THEN 2 ELSE 1 END) > 1),
    s AS (SELECT way_id, seq, n.node_id, sum((u.node_id IS NOT NULL)::INT) OVER w AS piece, lead(n.node_id) OVER w AS dst, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS step FROM n LEFT JOIN u ON n.node_id = u.node_id WINDOW w AS (PARTITION BY way_id ORDER BY seq))
    SELECT * FROM (SELECT way_id, piece::BIGINT AS piece, arg_min(node_id, seq) AS src, arg_max(dst, seq) AS dst, round(sum(step), 6) AS length_m FROM s WHERE dst IS NOT NULL GROUP BY 1, 2) WHERE src <> dst OR length_m > 0""")
def _(read):
    return graph.cut_ways(nodes(read)).withColumn("length_m", F.round("length_m", 6))


@query("gra_01_walk_graph")
def _(read):
    blocked = read("part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("node_id"))
    return graph.walk_graph(nodes(read), blocked).withColumn("length_m", F.round("length_m", 6))


@query("agg_04_components")
def _(read):
    length = F.col("l_quantity").cast("double").alias("length_m")
    return graph.measured_components(read("lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 100_000_000).alias("dst"), length))


@query("gra_03_shortest_paths", f"""WITH RECURSIVE g AS MATERIALIZED ({search.EDGES}), d AS MATERIALIZED (SELECT src AS a, dst AS b, min(length_m) AS c FROM (SELECT src, dst, length_m FROM g UNION ALL SELECT dst, src, length_m FROM g) GROUP BY ALL),
    l AS (SELECT 0 AS k, min(src) AS node, 0.0::DOUBLE AS cost FROM g UNION ALL SELECT k, node, min(cost) FROM (SELECT k + 1 AS k, b AS node, cost + c AS cost FROM l JOIN (FROM d UNION ALL SELECT DISTINCT a, a, 0.0 FROM d) ON node = a WHERE k < 24) GROUP BY ALL)
    SELECT node, round(cost, 6) AS cost FROM l WHERE k = 24""")
def _(read):
    edges = search.edges(read).select("src", "dst", F.col("length_m").alias("cost"))
    start = edges.agg(F.min("src").alias("node"))
    return graph.shortest_paths(edges, start).withColumn("cost", F.round("cost", 6))


@query("dtm_08_sun_position")
def _(read):
    azimuth, altitude = times.sun_position(F.col("ts").cast("timestamp"))
    return read("events").select("event_id", F.round(F.degrees(azimuth), 6).alias("azimuth"), F.round(F.degrees(altitude), 6).alias("altitude"))


@query("prj_29_sun_factor", """SELECT event_id, round(CASE WHEN a <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, a / 8)) * (1 - 0.8 * c * c) END, 9) AS factor
    FROM (SELECT event_id, event_id % 40 - 10.0 AS a, greatest(0.0, least(1.0, (event_id % 101) / 100.0)) AS c FROM events)""")
def _(read):
    factor = times.sun_factor(F.col("event_id") % 40 - 10.0, F.lit(None).cast("double"), F.col("event_id") % 101)
    return read("events").select("event_id", F.round(factor, 9).alias("factor"))


@query("str_05_clean_value", "SELECT p_partkey, nullif(substr(lower(trim(split_part(replace(p_type, ' ', ';'), ';', 1))), 1, 40), '') AS v FROM part")
def _(read):
    return read("part").select("p_partkey", text.clean_value(F.replace("p_type", F.lit(" "), F.lit(";"))).alias("v"))


@query("str_01_metres", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN round(p_size::DOUBLE * 0.3048::DOUBLE, 9) WHEN 1 THEN p_size::DOUBLE + 0.5 END AS m FROM part")
def _(read):
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit(" ft"))).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit(",5 m"))).otherwise(F.lit("tall"))
    return read("part").select("p_partkey", F.round(text.parse_metres(raw), 9).alias("m"))


@query("str_09_distance", """SELECT p_partkey, CASE WHEN d >= 995 THEN replace(printf('%.1f', floor(d / 1000 * 10 + 0.5) / 10), '.', ',') || ' km' WHEN d < 15 THEN greatest(1, floor(d + 0.5))::BIGINT || ' m'
    ELSE (floor(d / 10 + 0.5) * 10)::BIGINT || ' m' END AS t FROM (SELECT p_partkey, p_partkey % 400 * 7.0 / 2.5 AS d FROM part)""")
def _(read):
    return read("part").select("p_partkey", text.distance_text(F.col("p_partkey") % 400 * 7.0 / 2.5).alias("t"))


@query("str_11_plural", """SELECT p_partkey, CASE WHEN n = 1 THEN 'schody' WHEN n % 10 BETWEEN 2 AND 4 AND NOT n % 100 BETWEEN 12 AND 14 THEN 'odcinki' ELSE 'odcinków' END AS w
    FROM (SELECT p_partkey, abs(floor((p_partkey % 300 - 60) / 2.0 + 0.5)) AS n FROM part)""")
def _(read):
    return read("part").select("p_partkey", text.plural((F.col("p_partkey") % 300 - 60) / 2.0, "schody", "odcinki", "odcinków").alias("w"))


@query("str_07_clip", "SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS t FROM documents")
def _(read):
    return read("documents").select("doc_id", text.clip(F.col("text"), 60).alias("t"))


@query("str_19_assets", """SELECT page_id, len(list_distinct(regexp_extract_all('<a href="/assets/' || page_id % 7 || '.js"><img src="/assets/1.js"><img src="/other.js">' || html, '(?:src|href)="(/assets/[^"]+)"', 1))) AS n FROM pages""")
def _(read):
    head = F.concat(F.lit('<a href="/assets/'), (F.col("page_id") % 7).cast("string"), F.lit('.js"><img src="/assets/1.js"><img src="/other.js">'))
    return read("pages").select("page_id", F.size(text.asset_urls(F.concat(head, F.col("html")))).cast("long").alias("n"))


@query("win_23_chat_runs", """SELECT conv_id, run, min(role) AS role, sum(length(text))::BIGINT AS chars FROM (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (
    SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS c FROM (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2))) GROUP BY 1, 2""")
def _(read):
    turns = read("conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    runs = sequences.islands(turns, "conv_id", ["turn"], "role").withColumnRenamed("island", "run")
    return runs.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.sum(F.char_length("text")).cast("long").alias("chars"))


@query("agg_31_signature", "SELECT p_brand, (sum(abs(p_partkey)) % 1000003)::BIGINT AS signature FROM part GROUP BY 1")
def _(read):
    return read("part").groupBy("p_brand").agg((F.sum(F.abs("p_partkey")) % 1000003).alias("signature"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest way segment of every walker."""
    return QUERIES["jon_09_nearest_segment"](spark, sf_dir)
