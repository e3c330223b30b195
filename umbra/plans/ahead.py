"""Queries of marches over rasters and of hints along routes, with brute-force oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from umbra.functions import requests, text
from umbra.functions.geo import rounded
from umbra.operators import marches
from umbra.plans.registry import NODES, RASTER, query, raster, stand_in

# --- stand-ins: rays over the first 64 columns of a raster with cells of 5 m; routes of line items ------------------
RAYS = """SELECT c_custkey AS rid, c_custkey * 13 % 300 + 0.25::DOUBLE AS x, c_custkey * 29 % 950 + 0.5::DOUBLE AS y, c_custkey * 37 % 628 / 100.0::DOUBLE AS azimuth,
    CASE WHEN c_custkey % 17 = 0 THEN -0.1 ELSE 0.03 + c_custkey % 50 / 50.0 END::DOUBLE AS altitude, c_custkey % 4 = 0 AS leaf_off, 5.0::DOUBLE AS level FROM customer"""
STRETCHES = f"""SELECT way_id, seq AS seg, sum(len) OVER (PARTITION BY way_id ORDER BY seq) - len AS start_m, sum(len) OVER (PARTITION BY way_id ORDER BY seq) AS end_m, side, sun
    FROM (SELECT way_id, seq, 10.0 + node_id % 60 AS len, CASE node_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN '' END AS side, node_id % 11 / 10.0 AS sun FROM ({NODES}) n) s"""
WALKS = "SELECT o_orderkey AS fid, o_orderkey AS way_id, o_orderkey * 7 % 200 * 1.0 AS along_m, o_orderkey % 2 = 0 AS wants_sun FROM orders"


def _rays(read):
    df = stand_in(read, "customer", RAYS.replace("::DOUBLE", ""))
    return df.select("rid", "leaf_off", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "azimuth", "altitude", "level")))


def _ground(read):
    return raster(read).withColumn("value", F.abs("value") * 60)


_G = f'SELECT "row", "col", abs(value) * 60 AS value FROM ({RASTER})'
_UP = f"SELECT *, sin(azimuth) AS dx, cos(azimuth) AS dy, tan(altitude) AS slope, (SELECT max(value) FROM g) AS top FROM ({RAYS}) WHERE altitude > 0"
_CORNERS = " UNION ALL ".join(
    f'SELECT rid, z, floor(r)::BIGINT + {i} AS "row", floor(c)::BIGINT + {j} AS "col", {"r - floor(r)" if i else "1 - r + floor(r)"} AS wr, {"c - floor(c)" if j else "1 - c + floor(c)"} AS wc FROM s' for i in (0, 1) for j in (0, 1)
)


@query(
    "jon_15_behind_terrain",
    f"""WITH g AS ({_G}), u AS ({_UP}), d AS (SELECT *, (k + 0.5) * 5.0 AS d FROM u, (SELECT unnest(range(120)) AS k) WHERE (k + 0.5) * 5.0 <= least(600.0, (top - level) / slope)),
    a AS (SELECT rid, level + d * slope AS z, floor((y + dy * d) / 5.0)::BIGINT AS "row", floor((x + dx * d) / 5.0)::BIGINT AS "col", (y + dy * d) / 5.0 - 0.5 AS r, (x + dx * d) / 5.0 - 0.5 AS c FROM d),
    s AS (SELECT a.* FROM a SEMI JOIN g USING ("row", "col")), n AS ({_CORNERS}),
    b AS (SELECT rid, z, sum(value * wr * wc) / sum(wr * wc) AS ground FROM n JOIN g USING ("row", "col") GROUP BY rid, z) SELECT DISTINCT rid FROM b WHERE z < ground""",
)
def _(read):
    return marches.behind_terrain(_rays(read), _ground(read), 5.0)


@query(
    "jon_16_through_vegetation",
    f"""WITH g AS ({_G}), u AS (SELECT *, least(200.0, (top - 1.5) / slope) AS reach FROM ({_UP})), p AS (SELECT *, greatest(least(5.0, 2.0 / slope), reach / 128) AS step FROM u),
    s AS (SELECT *, k * step AS d FROM p, (SELECT unnest(range(129)) AS k) WHERE k < ceil(reach / step)),
    c AS (SELECT rid, 1.5 + d * slope AS low, step * slope AS rise, floor((y + dy * (d + step / 2)) / 5.0)::BIGINT AS "row", floor((x + dx * (d + step / 2)) / 5.0)::BIGINT AS "col" FROM s),
    o AS (SELECT rid, sum(greatest(0.0, least(low + rise, value) - greatest(low, CASE WHEN "col" % 3 = 0 THEN 1.0 + value / 4 ELSE greatest(2.0, 0.35 * value) END))) AS depth
        FROM c JOIN g USING ("row", "col") WHERE value > 2 GROUP BY rid)
    SELECT rid, floor(greatest(0.05, exp(-coalesce(depth, 0.0) * CASE WHEN leaf_off THEN {-math.log(0.7) / 6!r} ELSE {math.log(4) / 6!r} END / sin(altitude))) * 1e6 + 0.5) / 1e6 AS share FROM u LEFT JOIN o USING (rid)""",
)
def _(read):
    tops = _ground(read).withColumn("base", F.when(F.col("col") % 3 == 0, 1.0 + F.col("value") / 4))
    return marches.through_vegetation(_rays(read), tops, 5.0).select("rid", rounded(F.col("share"), 6).alias("share"))


_CLASS = "CASE WHEN sun <= 0.35 THEN 'shade' WHEN sun >= 0.65 THEN 'sun' ELSE 'mixed' END"


@query(
    "win_19_hints",
    f"""WITH r AS (SELECT way_id, seg, start_m, end_m, nullif(side, '') AS side, {_CLASS} AS class FROM ({STRETCHES})),
    q AS (SELECT a.way_id AS way_id, a.seg, a.start_m, a.end_m, a.side, a.class, coalesce(min(b.start_m) FILTER (b.class <> a.class AND b.seg > a.seg), max(b.end_m)) - a.start_m AS run_m FROM r a JOIN r b USING (way_id) GROUP BY a.way_id, a.seg, a.start_m, a.end_m, a.side, a.class),
    f AS ({WALKS}), m AS (SELECT fid, min(seg) AS seg FROM f JOIN r USING (way_id) WHERE along_m < end_m GROUP BY fid),
    h AS (SELECT f.*, r.seg AS at_seg, r.side AS at_side, r.class AS at_class FROM m JOIN f USING (fid) JOIN r ON r.way_id = f.way_id AND r.seg = m.seg),
    n AS (SELECT h.*, q.seg, q.side, q.class, q.run_m, q.start_m - along_m AS distance_m FROM h JOIN q ON h.way_id = q.way_id AND q.seg > at_seg AND q.start_m - along_m <= 150),
    s AS (SELECT * FROM n WHERE side <> at_side QUALIFY row_number() OVER (PARTITION BY fid ORDER BY seg) = 1),
    e AS (SELECT * FROM n WHERE at_class <> 'mixed' AND class <> 'mixed' AND class <> at_class AND run_m >= 40 QUALIFY row_number() OVER (PARTITION BY fid ORDER BY seg) = 1)
    SELECT fid, 'side' AS what, seg, distance_m::DOUBLE AS distance_m, NULL::DOUBLE AS run_m, true AS good FROM s WHERE distance_m >= 10 UNION ALL
    SELECT fid, class, seg, distance_m::DOUBLE, run_m::DOUBLE, (class = 'sun') = wants_sun FROM e WHERE distance_m >= 10 AND fid NOT IN (SELECT fid FROM s WHERE distance_m >= 10)""",
)
def _(read):
    plain = stand_in(read, "lineitem", STRETCHES)
    lanes = plain.select("way_id", "seg", "side", *(F.col(c).cast("double").alias(c) for c in ("start_m", "end_m", "sun")))
    walks = stand_in(read, "orders", WALKS).withColumn("along_m", F.col("along_m").cast("double"))
    return marches.hints(walks, lanes, "way_id")


#: Values of requests, some of which are not valid.
ASKED = """SELECT c_custkey AS id, '20' || (10 + c_custkey % 80) || '-0' || (1 + c_custkey % 9) || '-' || (10 + c_custkey % 23) || 'T' || (10 + c_custkey % 16) || ':' || (10 + c_custkey % 53)
    || CASE c_custkey % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN ':30-0530' ELSE '' END AS moment,
    (c_custkey % 7) || ', ' || (c_custkey % 97) || ',' || (c_custkey % 5) || '.5,' || CASE WHEN c_custkey % 11 = 0 THEN 'x' WHEN c_custkey % 13 = 0 THEN '50,1' ELSE '' || c_custkey % 101 END AS box,
    CASE c_custkey % 4 WHEN 0 THEN 'senior' WHEN 1 THEN 'accessible' WHEN 2 THEN 'fast' END AS profile FROM customer"""


@query(
    "flt_22_requests",
    f"""SELECT id, CASE WHEN regexp_matches(moment, 'T(1[0-9]|2[0-3]):[1-5][0-9](:30)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') AND try_cast(substr(moment, 1, 10) AS DATE) IS NOT NULL THEN moment END AS moment,
    CASE WHEN id % 11 > 0 AND id % 13 > 0 AND id % 7 < id % 5 + 0.5 AND id % 97 < id % 101 AND id % 97 <= 90 AND id % 101 <= 90 THEN (id % 101)::DOUBLE END AS north,
    CASE WHEN profile IS NULL THEN 'default' WHEN profile <> 'fast' THEN profile END AS profile FROM ({ASKED})""",
)
def _(read):
    asked = stand_in(read, "customer", ASKED)
    profile = requests.one_of(F.col("profile"), ["default", "accessible", "senior"], "default").alias("profile")
    return asked.select("id", requests.moment(F.col("moment")).alias("moment"), F.get(requests.bounds(F.col("box")), F.lit(3)).alias("north"), profile)


@query("str_17_sentences")
def _(read):
    """No oracle: the engine for it has no look-behind; tested against a plain walk over matches."""
    return read("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "sentence"))
