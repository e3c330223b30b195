"""Query of height tiles: rasters of the embeddings written as tile files and read back with bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from umbra.plans.registry import RASTER, query, raster
from umbra.shared import shared_dir
from umbra.sources.heights import read_heights, write_heights

_METRES = "floor(greatest(0.0, value * 40 + 12) * 10 + 0.5) / 10"


@query("src_16_height_tiles", f"""SELECT '0_' || ("row" // 64) AS tile, "col" + 0.5::DOUBLE AS x, "row" + 0.5::DOUBLE AS y, CASE WHEN value <= 0.15 THEN round({_METRES}, 6) END AS metres
    FROM ({RASTER}) WHERE "col" >= 7 AND "col" < 50""")
def _(read):
    """Every 64 rows of the raster are a tile: written, then read where 7 <= x < 50."""
    cells = raster(read).select(
        F.concat(F.lit("0_"), F.floor(F.col("row") / 64).cast("string")).alias("tile"), F.explode(F.array(F.lit("ndsm"), F.lit("terrain"))).alias("layer"), (F.col("col") + 0.5).alias("x"),
        (F.col("row") + 0.5).alias("y"), F.when(F.col("value") <= 0.15, F.col("value") * 40 + 12).alias("metres"),
    )
    spark = cells.sparkSession
    folder = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    write_heights(cells, folder, {"ndsm": 1, "terrain": 1})
    found = read_heights(spark, folder).where("layer = 'ndsm' AND x >= 7 AND x < 50")
    return found.select("tile", "x", "y", F.round("metres", 6).alias("metres"))
