"""Marches of rays over rasters and hints of what lies ahead on a route."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.operators.scene import CROWN, CROWN_BARE, EYE, LEAST, MOST_RAY
from umbra.operators.sequences import islands
from umbra.operators.spatial import bilinear, cell
from umbra.shared import within

#: Longest ray through vegetation (m), most steps and most rise of one (m), full crown depth (m), lowest base (m) and its share of the top.
VEGETATION_RAY, MOST_STEPS, STEP_RISE, DEPTH, LOW_BASE, BASE_SHARE = 200.0, 128, 2.0, 6.0, 2.0, 0.35
#: How far hints look, how near they come and how long a stretch they tell of (m); sun shares that count as shade and as sun.
LOOK_AHEAD, NEAREST, LEAST_RUN, SHADE_TO, SUN_FROM = 150.0, 10.0, 40.0, 0.35, 0.65


def _direction(rays: DataFrame) -> DataFrame:
    return rays.where("altitude > 0").withColumns({"dx": F.sin("azimuth"), "dy": F.cos("azimuth"), "slope": F.tan("altitude")})


def _tallest(raster: DataFrame) -> float:
    top = raster.where(~F.isnan("value")).agg(F.max("value").alias("top")).first()["top"]
    return -math.inf if top is None else float(top)


def behind_terrain(rays: DataFrame, terrain: DataFrame, size: float) -> DataFrame:
    """Rays (rid, x, y, level: height of the eye, azimuth, altitude) that the ground (row, col, value; origin 0) hides.

    One sample a cell from half a cell on, up to the highest ground and ``MOST_RAY``; the ground is bilinear and counts
    where the sample's own cell has a value. Each sample looks up four cells by an equi-join.
    """
    up = _direction(rays).withColumn("reach", F.least(F.lit(MOST_RAY), (F.lit(_tallest(terrain)) - F.col("level")) / F.col("slope")))
    steps = F.floor(F.col("reach") / size - 0.5).cast("int")
    at = up.where(F.col("reach") >= size / 2).withColumn("d", F.explode(F.transform(F.sequence(F.lit(0), steps), lambda k: (k + 0.5) * size)))
    px, py = F.col("x") + F.col("dx") * F.col("d"), F.col("y") + F.col("dy") * F.col("d")
    known = terrain.where("value IS NOT NULL AND NOT isnan(value)").select("row", "col")
    samples = at.select("rid", (F.col("level") + F.col("d") * F.col("slope")).alias("z"), px.alias("px"), py.alias("py")).withColumns({"row": cell(F.col("py"), size), "col": cell(F.col("px"), size)})
    # What a few columns of rays are spread into is far larger than it is estimated, so it is never sent to all tasks.
    samples = samples.hint("merge").join(within(known), ["row", "col"], "left_semi")
    ground = bilinear(samples.select(F.struct("rid", "z").alias("pid"), (F.col("py") / size - 0.5).alias("r"), (F.col("px") / size - 0.5).alias("c")), terrain)
    return ground.where(F.col("pid.z") < F.col("value")).select("pid.rid").distinct()


def through_vegetation(rays: DataFrame, tops: DataFrame, size: float) -> DataFrame:
    """Share of sun (rid, share) that vegetation (row, col, value: top over the ground, base or null; origin 0) lets through.

    Steps of a cell, shorter where a step would rise more than ``STEP_RISE``, at most ``MOST_STEPS`` to the reach; each
    adds the height it shares with the crown of the cell at its middle. Rays without sun have no row, rays that meet
    nothing 1. Steps start at the point also where it lies outside of the raster.
    """
    bare = F.coalesce(F.col("leaf_off"), F.lit(False))
    up = _direction(rays).withColumn("reach", F.least(F.lit(VEGETATION_RAY), (F.lit(_tallest(tops)) - EYE) / F.col("slope")))
    step = F.greatest(F.least(F.lit(size), STEP_RISE / F.col("slope")), F.col("reach") / MOST_STEPS)
    at = up.where("reach > 0").withColumn("step", step).withColumn("d", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("reach") / F.col("step")).cast("int") - 1), lambda k: k * F.col("step"))))
    middle = F.col("d") + F.col("step") / 2
    at = at.select("rid", (EYE + F.col("d") * F.col("slope")).alias("low"), (F.col("step") * F.col("slope")).alias("rise"), cell(F.col("y") + F.col("dy") * middle, size).alias("row"), cell(F.col("x") + F.col("dx") * middle, size).alias("col"))
    # What a few columns of rays are spread into is far larger than it is estimated, so it is never sent to all tasks.
    met = at.hint("merge").join(within(tops.where(F.col("value") > LOW_BASE)), ["row", "col"])
    base = F.coalesce("base", F.greatest(F.lit(LOW_BASE), BASE_SHARE * F.col("value")))
    shared = F.least(F.col("low") + F.col("rise"), F.col("value")) - F.greatest(F.col("low"), base)
    depth = met.withColumn("shared", shared).where("shared > 0").groupBy("rid").agg(F.sum("shared").alias("depth"))
    fading = F.when(bare, -math.log(CROWN_BARE) / DEPTH).otherwise(-math.log(CROWN) / DEPTH) / F.sin("altitude")
    share = F.greatest(F.lit(LEAST), F.exp(-fading * F.coalesce("depth", F.lit(0.0))))
    return rays.where("altitude > 0").select("rid", "altitude", "leaf_off").join(depth, "rid", "left").select("rid", share.alias("share"))


def exposure_class(sun: Column) -> Column:
    return F.when(sun <= SHADE_TO, "shade").when(sun >= SUN_FROM, "sun").otherwise("mixed")


def hints(fixes: DataFrame, segments: DataFrame, part: str) -> DataFrame:
    """What lies ahead of fixes (fid, part, along_m, wants_sun): fid, what ('side', 'sun' or 'shade'), seg, distance_m, run_m, good.

    ``segments`` (part, seg, start_m, end_m, side or null, sun). First a change of the side, then the first stretch of
    ``LEAST_RUN`` that is sunny where here is shade or the reverse; none nearer than ``NEAREST`` or beyond ``LOOK_AHEAD``.
    A fix without a hint, past the end or without a route has no row. Only segments in sight are joined to a fix.
    """
    runs = islands(segments.withColumn("class", exposure_class(F.col("sun"))), part, ["seg"], "class")
    runs = runs.withColumn("run_m", F.max("end_m").over(W.partitionBy(part, "island")) - F.col("start_m")).withColumn("side", F.nullif("side", F.lit("")))
    seen = fixes.join(runs, part).where(F.col("end_m") > F.col("along_m")).withColumn("distance_m", F.col("start_m") - F.col("along_m")).where(F.col("distance_m") <= LOOK_AHEAD)
    w = W.partitionBy("fid").orderBy("seg")
    seen = seen.withColumn("here", F.first(F.struct("seg", "side", "class")).over(w)).where("seg > here.seg")
    row = F.struct("seg", "distance_m", "run_m", "class")
    turned = (F.col("class") != F.col("here.class")) & (F.col("class") != "mixed") & (F.col("here.class") != "mixed") & (F.col("run_m") >= LEAST_RUN)
    best = seen.groupBy("fid", "wants_sun").agg(F.min(F.when(F.col("side") != F.col("here.side"), row)).alias("crossing"), F.min(F.when(turned, row)).alias("stretch"))
    crossing = F.col("crossing.distance_m") >= NEAREST
    found = best.withColumn("h", F.when(crossing, F.col("crossing")).when(F.col("stretch.distance_m") >= NEAREST, F.col("stretch"))).where("h IS NOT NULL")
    side = F.coalesce(crossing, F.lit(False))
    good = side | ((F.col("h.class") == "sun") == F.col("wants_sun"))
    return found.select("fid", F.when(side, "side").otherwise(F.col("h.class")).alias("what"), "h.seg", "h.distance_m", F.when(~side, F.col("h.run_m")).alias("run_m"), good.alias("good"))
