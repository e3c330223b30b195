"""Exposure to the sun along rays through buildings, canopies and tree crowns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.geo import in_ring
from umbra.operators.spatial import box_cells, cell
from umbra.shared import stash

#: Longest ray and eye height (m); share of sun that full crowns, canopies from inside and from afar let through, in leaf and without; least share under vegetation.
MOST_RAY, EYE = 600.0, 1.5
CROWN, CROWN_BARE = 0.25, 0.7
INSIDE, INSIDE_BARE, CAST, CAST_BARE = 0.15, 0.6, 0.3, 0.75
LEAST = 0.05
#: Side of the cells (m) that rays and bodies meet in.
CELL = 40.0


def walls(bodies: DataFrame) -> DataFrame:
    """Sides (ax, ay, bx, by) of bodies (oid, kind, ring of x and y, top, bottom); hanging bodies keep their ring."""
    ends = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    sides = F.explode(F.arrays_zip(F.col("ring").alias("a"), ends.alias("b"))).alias("s")
    kept = F.when(F.col("bottom") > 0, F.col("ring")).alias("ring")
    out = bodies.where(F.size("ring") > 1).select("oid", "kind", "top", "bottom", kept, sides)
    return out.select("oid", "kind", "top", "bottom", "ring", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def ray_cells(rays: DataFrame, size: float) -> DataFrame:
    """Each ray (x, y, dx, dy, reach) once per cell (cx, cy) that it passes, by the boxes of its pieces of a cell's length."""

    def around(i: Column) -> Column:
        near, far = i * size, F.least((i + 1) * size, F.col("reach"))
        span = lambda p, d: F.sequence(*(cell(pick(p + d * near, p + d * far) + e, size) for pick, e in ((F.least, -1e-6), (F.greatest, 1e-6))))
        columns, rows = span(F.col("x"), F.col("dx")), span(F.col("y"), F.col("dy"))
        return F.flatten(F.transform(columns, lambda cx: F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))

    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("reach") / size).cast("int") - 1, F.lit(0)))
    return rays.withColumn("c", F.explode(F.array_distinct(F.flatten(F.transform(steps, around))))).select(*rays.columns, "c.cx", "c.cy")


def _crossing(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """Distance along the ray and share of side a-b at which they meet; null where parallel."""
    ex, ey, wx, wy = b[0] - a[0], b[1] - a[1], a[0] - F.col("x"), a[1] - F.col("y")
    across = F.nullif(F.col("dx") * ey - F.col("dy") * ex, F.lit(0.0))
    return (wx * ey - wy * ex) / across, (wx * F.col("dy") - wy * F.col("dx")) / across


def _through_hanging() -> Column:
    """Whether the ray passes a hanging body between two crossings of its ring, below its top and not wholly below its bottom."""
    ring = F.col("ring")
    ends = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def meets(a: Column, b: Column) -> Column:
        d, u = _crossing((a["x"], a["y"]), (b["x"], b["y"]))
        return F.when((d >= 0) & (u >= 0) & (u < 1), d)

    found = F.array_sort(F.filter(F.zip_with(ring, ends, meets), lambda d: d.isNotNull()))
    rise = lambda i: EYE + F.element_at(found, i) * F.col("slope")
    pairs = F.when(F.size(found) > 1, F.sequence(F.lit(1), F.size(found) - 1, F.lit(2)))
    return F.coalesce(F.exists(pairs, lambda i: (rise(i) < F.col("top")) & (rise(i + 1) >= F.col("bottom"))), F.lit(False))


def exposure(rays: DataFrame, bodies: DataFrame, trees: DataFrame, size: float = CELL) -> DataFrame:
    """Share of direct sun (rid, exposure) at points (rid, x, y, azimuth, altitude in radians, leaf_off).

    ``bodies`` (oid, kind 'building' or 'canopy', ring, top, bottom), ``trees`` (oid, x, y, height, radius, evergreen).
    No sun for an altitude of 0 or less, inside a building's ring or behind a building; canopies and crowns multiply,
    each once, to ``LEAST`` at least. Without bodies and trees the exposure is 1. Rays and sides meet in cells: an
    equi-join that adaptive execution splits; what a ray meets is folded per object, then per ray. What is spread over cells is far
    larger than it is estimated, so it is sorted and never sent to all tasks. A crown counts in the cell where the ray enters it.
    """
    flat = F.coalesce(F.col("leaf_off"), F.lit(False))
    up = rays.where("altitude > 0").select("rid", "x", "y", F.sin("azimuth").alias("dx"), F.cos("azimuth").alias("dy"), F.tan("altitude").alias("slope"), flat.alias("bare"))
    tallest = bodies.select("top").unionAll(trees.select("height")).agg(F.max("top").alias("top")).first()["top"] or 0.0
    up = up.withColumn("reach", F.greatest(F.lit(0.0), F.least(F.lit(MOST_RAY), (tallest - EYE) / F.col("slope"))))
    passing = ray_cells(up, size)
    by_leaf = lambda leaf, bare: F.when(F.col("bare"), math.log(bare)).otherwise(math.log(leaf))

    a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    spread = box_cells(walls(bodies), F.least(a[0], b[0]), F.greatest(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[1], b[1]), size=size)
    d, u = _crossing(a, b)
    met = passing.join(spread.hint("merge"), ["cx", "cy"]).withColumn("d", d).withColumn("u", u).where("d >= 0 AND d <= reach AND u BETWEEN 0 AND 1")
    met = met.withColumn("level", EYE + F.col("d") * F.col("slope")).where("level < top")
    solid = (F.col("kind") == "building") & ((F.col("level") >= F.col("bottom")) | _through_hanging())
    crossed = met.select("rid", "kind", "oid", solid.alias("dark"), F.when(F.col("kind") == "canopy", by_leaf(CAST, CAST_BARE)).alias("ln"))

    side = lambda pick, c: pick(F.transform("ring", lambda p: p[c]))
    area = box_cells(bodies, side(F.array_min, "x"), side(F.array_max, "x"), side(F.array_min, "y"), side(F.array_max, "y"), size=size)
    here = up.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    within = here.join(area.hint("merge"), ["cx", "cy"]).where(in_ring(F.col("ring"), F.col("x"), F.col("y")))
    within = within.select("rid", "kind", "oid", (F.col("kind") == "building").alias("dark"), F.when(F.col("kind") == "canopy", by_leaf(INSIDE, INSIDE_BARE)).alias("ln"))

    half = F.least(F.col("radius"), F.col("height") / 2)
    crowns = trees.where("radius > 0 AND height > 0").select("oid", F.col("x").alias("tx"), F.col("y").alias("ty"), "radius", (F.col("height") - half).alias("mid"), (F.col("radius") / half).alias("flat"), F.coalesce("evergreen", F.lit(False)).alias("evergreen"))
    # An object counts once; of a canopy the darker of inside and cast. Crowns that coincide are met once, with their number, and only by rays that no building stops.
    crowns = crowns.groupBy(*(c for c in crowns.columns if c != "oid")).agg(F.count(F.lit(1)).alias("n"))
    bodily = crossed.unionByName(within).groupBy("rid", "kind", "oid").agg(F.bool_or("dark").alias("dark"), F.min("ln").alias("ln"))
    bodily = stash(bodily.groupBy("rid").agg(F.bool_or("dark").alias("dark"), F.sum("ln").alias("ln")), "exposure-bodies")
    lit = up.join(bodily.where("dark").select("rid"), "rid", "left_anti")
    # Crowns are small and low: finer cells, and rays only up to the tallest tree.
    fine, highest = size / 4, trees.agg(F.max("height").alias("top")).first()["top"] or 0.0
    low = lit.withColumn("reach", F.least("reach", F.greatest(F.lit(0.0), (highest - EYE) / F.col("slope")) + 1e-6))
    wide = F.col("radius") + 1e-6
    box = [F.col("tx") - wide, F.col("tx") + wide, F.col("ty") - wide, F.col("ty") + wide]
    ox, oy, oz, dz = F.col("x") - F.col("tx"), F.col("y") - F.col("ty"), (EYE - F.col("mid")) * F.col("flat"), F.col("slope") * F.col("flat")
    seen = ray_cells(low, fine).join(box_cells(crowns, *box, size=fine).hint("merge"), ["cx", "cy"]).withColumn("qa", 1 + dz * dz).withColumn("qb", ox * F.col("dx") + oy * F.col("dy") + oz * dz)
    seen = seen.withColumn("disc", F.col("qb") * F.col("qb") - F.col("qa") * (ox * ox + oy * oy + oz * oz - F.col("radius") * F.col("radius"))).where("disc > 0")
    far, near = (F.sqrt("disc") - F.col("qb")) / F.col("qa"), F.greatest((-F.sqrt("disc") - F.col("qb")) / F.col("qa"), F.lit(0.0))
    full = F.when(F.col("bare") & ~F.col("evergreen"), math.log(CROWN_BARE)).otherwise(math.log(CROWN))
    entered = (F.col("cx") == cell(F.col("x") + F.col("dx") * near, fine)) & (F.col("cy") == cell(F.col("y") + F.col("dy") * near, fine))
    crowned = seen.where((far > 0) & (near <= F.col("reach")) & entered).select("rid", (F.col("n") * (full * (far - near) * F.sqrt("qa") / (2 * F.col("radius")))).alias("ln"))
    crowned = crowned.groupBy("rid").agg(F.lit(False).alias("dark"), F.sum("ln").alias("ln"))

    folded = bodily.unionByName(crowned).groupBy("rid").agg(F.bool_or("dark").alias("dark"), F.sum("ln").alias("ln"))
    share = F.when((F.col("altitude") <= 0) | F.col("altitude").isNull() | F.coalesce("dark", F.lit(False)), 0.0).otherwise(F.greatest(F.lit(LEAST), F.exp(F.coalesce("ln", F.lit(0.0)))))
    return rays.select("rid", "altitude").join(folded, "rid", "left").select("rid", share.alias("exposure"))
