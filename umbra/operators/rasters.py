"""Operators on rasters of (row, col, value) and on points in rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.functions.geo import in_ring
from umbra.operators.spatial import box_cells, cell
from umbra.shared import within


def dilate(cells: DataFrame, radius: int, rows: int, cols: int) -> DataFrame:
    """Cells within ``radius`` of a set one, by the larger of both differences; along rows first, then along columns."""
    along = lambda df, c, most: df.withColumn(c, F.explode(F.sequence(F.greatest(F.col(c) - radius, F.lit(0)), F.least(F.col(c) + radius, F.lit(most - 1))))).distinct()
    return along(along(cells.select("row", "col"), "col", cols), "row", rows)


def difference(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Height of one raster over another where both have a value."""
    return upper.join(lower.withColumnRenamed("value", "below"), ["row", "col"]).select("row", "col", (F.col("value") - F.col("below")).alias("value")).where("value IS NOT NULL")


def outside_coverage(points: DataFrame, raster: DataFrame, size: float) -> DataFrame:
    """Points (px, py) whose cell has no value in the raster."""
    here = points.withColumn("row", cell(F.col("py"), size)).withColumn("col", cell(F.col("px"), size))
    return here.join(raster.where("value IS NOT NULL").select("row", "col"), ["row", "col"], "left_anti").select(points.columns)


def in_rings(points: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """Pairs of points (pid, px, py) and the rings (rid, ring of x, y) they lie in.

    Rings are spread over the cells of their box, points look into their own cell: an equi-join, then the parity test. Points
    at one place and rings of one shape are tested once; few rings are sent to every task, so most pairs are never shuffled.
    """
    side = lambda pick, c: pick(F.transform("ring", lambda p: p[c]))
    box = [side(F.array_min, "x"), side(F.array_max, "x"), side(F.array_min, "y"), side(F.array_max, "y")]
    spread = box_cells(rings.select("ring").distinct(), *box, size=size)
    here = points.select("px", "py").distinct().withColumn("cx", cell(F.col("px"), size)).withColumn("cy", cell(F.col("py"), size))
    met = here.join(spread.hint("merge"), ["cx", "cy"]).where(in_ring(F.col("ring"), F.col("px"), F.col("py"))).select("px", "py", "ring")
    return points.join(met.hint("merge"), ["px", "py"]).join(within(rings.select("rid", "ring")), "ring").select("pid", "rid")


def composite(scenes: DataFrame) -> DataFrame:
    """Value of each cell over scenes (scene, row, col, value): mean of the scenes' medians plus the median anomaly of the cell."""
    medians = scenes.groupBy("scene").agg(F.median("value").alias("mid"))
    level = medians.agg(F.avg("mid").alias("level")).first()["level"]
    odd = scenes.join(medians, "scene").groupBy("row", "col").agg(F.median(F.col("value") - F.col("mid")).alias("odd"))
    return odd.select("row", "col", (F.lit(level) + F.col("odd")).alias("value"))


def nearest_filled(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``cells`` (by, row, col, value) with every null or NaN value replaced by that of the nearest cell that has one.

    Distance is the number of steps to cells that share a side; of equally near cells the first in order of rows and columns counts, as
    in a search that starts from all cells with values at once. A grid without any value stays empty. The distance is a sum
    over both axes, so the nearest of each column comes first, from two running values along it, and then the least of
    distance minus and plus column, from two running minima along the row: four windows and no rounds. All of them run from the
    start, down or up, since a frame that reaches to the end is gone through again for every row.
    """
    by = by or []
    value = F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value"))
    column, line = W.partitionBy(*by, "col"), W.partitionBy(*by, "row")
    running = (W.unboundedPreceding, W.currentRow)
    here = F.when(value.isNotNull(), F.struct(F.col("row").alias("r"), F.col("col").alias("c"), value.alias("v")))
    cells = cells.withColumn("seed", here)
    cells = cells.withColumn("above", F.last("seed", ignorenulls=True).over(column.orderBy("row").rowsBetween(*running)))
    cells = cells.withColumn("below", F.last("seed", ignorenulls=True).over(column.orderBy(F.desc("row")).rowsBetween(*running)))
    far = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col("row") - F.col(s)["r"]).alias("d"), F.col(s).alias("s")))
    cells = cells.withColumn("near", F.least(far("above"), far("below")))
    shifted = lambda sign: F.when(F.col("near").isNotNull(), F.struct((F.col("near.d") + sign * F.col("col")).alias("d"), F.col("near.s").alias("s")))
    west = F.min(shifted(-1)).over(line.orderBy("col").rowsBetween(*running))
    east = F.min(shifted(1)).over(line.orderBy(F.desc("col")).rowsBetween(*running))
    cells = cells.withColumns({"west": west, "east": east})
    back = lambda s, sign: F.when(F.col(s).isNotNull(), F.struct((F.col(s)["d"] + sign * F.col("col")).alias("d"), F.col(s)["s"].alias("s")))
    best = F.least(back("west", 1), back("east", -1))
    return cells.withColumn("value", F.coalesce(value, best["s"]["v"])).drop("seed", "above", "below", "near", "west", "east")
