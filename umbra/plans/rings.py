"""Queries of rings and masks: lines from orders, yards from parts, masks from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.operators import rasters, rings
from umbra.plans.registry import RASTER, query, raster

#: Corners 0 to n - 1 of an order's ring, in lines of three sides, some reversed, numbered out of order; one line is missing now and then.
_LINES = "SELECT o_orderkey AS element, 7 + o_orderkey % 6 AS n, o_orderkey % 11 = 0 AS broken FROM orders"
_POINT = "({0} * 10.0)::DOUBLE AS x, ({0} * {0} % 7 * 5.0)::DOUBLE AS y"


def _lines(read):
    of = read("orders").select(F.col("o_orderkey").alias("element"), (7 + F.col("o_orderkey") % 6).alias("n"), (F.col("o_orderkey") % 11 == 0).alias("broken"))
    of = of.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 3)))).where("NOT (broken AND j = 1)")
    of = of.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(3).cast("long"), F.col("n") - 3 * F.col("j")))))
    corner = (3 * F.col("j") + F.col("k")) % F.col("n")
    back = (F.col("element") + F.col("j")) % 2 == 1
    return of.select(
        "element", F.lit("outer").alias("role"), ((F.col("j") * 5 + F.col("element")) % 17).alias("piece"), F.when(back, -F.col("k")).otherwise(F.col("k")).alias("seq"),
        (corner * 10.0).alias("x"), (corner * corner % 7 * 5.0).alias("y"),
    )


@query("jon_07_assembled", f"""WITH l AS ({_LINES}), p AS (SELECT element, n, j, (j * 5 + element) % 17 AS piece, (element + j) % 2 = 1 AS back FROM (SELECT *, unnest(range(0, (n - 1) // 3 + 1)) AS j FROM l WHERE NOT broken)),
    f AS (SELECT element, n, arg_min(j, piece) AS j, arg_min(back, piece) AS back, min(piece) AS ring FROM p GROUP BY 1, 2),
    v AS (SELECT element, ring, s + 1 AS seq, CASE WHEN back THEN (least(3 * j + 3, n) - s + 2 * n) % n ELSE (3 * j + s) % n END AS c FROM (SELECT *, unnest(range(0, n + 1)) AS s FROM f))
    SELECT element, ring, seq::INT AS seq, {_POINT.format('c')} FROM v""")
def _(read):
    return rings.assembled(_lines(read)).select("element", "ring", "seq", "x", "y")


def _square(i, x, y, size):
    """Rows of a closed square of a part: ring, role, seq, x, y."""
    corners = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    role = "outer" if i < 2 else "inner"
    return [F.struct(F.lit(i).alias("ring"), F.lit(role).alias("role"), F.lit(k).alias("seq"), (x + a * size).alias("x"), (y + b * size).alias("y")) for k, (a, b) in enumerate(corners, 1)]


@query("jon_08_yards", """SELECT p_partkey AS element, 2 AS hole, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN s BETWEEN 0 AND 39 THEN 0 WHEN s BETWEEN 60 AND 99 THEN 1 END AS outer FROM (SELECT p_partkey, p_partkey % 120 AS s FROM part)""")
def _(read):
    """Two outers of 40 m, 20 m apart (every third part has the first only), and a yard of 1 m at varying places."""
    squares = _square(0, F.lit(0.0), F.lit(0.0), 40.0) + _square(1, F.lit(60.0), F.lit(0.0), 40.0) + _square(2, F.col("p_partkey") % 120 + 0.25, F.col("p_partkey") % 38 + 0.5, 0.5)
    points = read("part").select(F.col("p_partkey").alias("element"), F.explode(F.array(*squares)).alias("p")).select("element", "p.*").where("NOT (element % 3 = 0 AND ring = 1)")
    return rings.holes_in_outers(points)


_MASK = f"SELECT \"row\" AS r, \"col\" AS c FROM ({RASTER}) WHERE value > 0.02"
#: The number of cells of the mask around each corner, and whether they are two that touch only there.
_AROUND = f"""WITH m AS MATERIALIZED ({_MASK}), a AS (SELECT r + i AS y, c + j AS x, count(*) AS n, sum(CASE WHEN i = j THEN 1 ELSE 0 END) AS d FROM m, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) GROUP BY 1, 2)"""


def _mask(read):
    return raster(read).where("value > 0.02").select("row", "col")


@query("mth_14_mask_corners", f"{_AROUND} SELECT x::DOUBLE AS x, y::DOUBLE AS y, CASE WHEN n = 2 THEN 2 ELSE 1 END::BIGINT AS corners FROM a WHERE n IN (1, 3) OR (n = 2 AND d <> 1)")
def _(read):
    return rings.mask_rings(_mask(read), 1).groupBy("x", "y").agg(F.count(F.lit(1)).alias("corners"))


@query("mth_14_mask_area", f"{_AROUND} SELECT (SELECT count(*) FROM m)::DOUBLE AS area, (sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND d <> 1 THEN 2 ELSE 0 END) / 4)::BIGINT AS rings_less_holes FROM a")
def _(read):
    found = rings.mask_rings(_mask(read), 1).select("ring", "area").distinct()
    return found.agg(F.sum("area").alias("area"), F.sum(F.when(F.col("area") > 0, 1).otherwise(-1)).alias("rings_less_holes"))


@query("mth_14_simplified")
def _(read):
    found = rings.mask_rings(_mask(read))
    return rings.simplified(found, 0.75, ["ring"]).select("ring", "seq", "x", "y")


@query("win_24_filled", f"""WITH g AS MATERIALIZED (SELECT "row" AS r, "col" AS c, CASE WHEN value <= 0.02 THEN value END AS v FROM ({RASTER})),
    f AS (SELECT h.r, h.c, arg_min(s.v, (abs(h.r - s.r) + abs(h.c - s.c), s.r, s.c)) AS v FROM g h JOIN (SELECT * FROM g WHERE v IS NOT NULL) s ON s.r BETWEEN h.r - 8 AND h.r + 8 AND s.c BETWEEN h.c - 8 AND h.c + 8
        WHERE h.v IS NULL AND abs(h.r - s.r) + abs(h.c - s.c) <= 8 GROUP BY 1, 2)
    SELECT r AS "row", c AS "col", round(coalesce(g.v, f.v), 9) AS value FROM g LEFT JOIN f USING (r, c)""")
def _(read):
    holes = raster(read).withColumn("value", F.when(F.col("value") <= 0.02, F.col("value")))
    return rasters.nearest_filled(holes).select("row", "col", F.round("value", 9).alias("value"))
