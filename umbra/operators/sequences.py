"""Ordered-sequence, raster and scoring operators over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.functions.geo import rounded


def running_length(df: DataFrame, part: str, order: list[str], x: str, y: str) -> DataFrame:
    """Adds ``cum``: length of the polyline up to each point."""
    w = W.partitionBy(part).orderBy(*order)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return df.withColumn("step", step).withColumn("cum", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("step")


def islands(df: DataFrame, part: str, order: list[str], value: str) -> DataFrame:
    """Adds ``island``: number of the run of equal values."""
    w = W.partitionBy(part).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("changed", changed).withColumn("island", F.sum("changed").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("changed")


def first_wins(df: DataFrame, key: str, order: list[str], any_of: list[str]) -> DataFrame:
    """One row per key, the first by order; flags in ``any_of`` are true if any row's is."""
    rest = [c for c in df.columns if c != key and c not in any_of]
    row = F.min_by(F.struct(*rest), F.struct(*order))
    out = df.groupBy(key).agg(row.alias("row"), *(F.bool_or(c).alias(c) for c in any_of))
    return out.select(key, *(f"row.{c}" for c in rest), *any_of)


def strikes(df: DataFrame, part: str, order: list[str], offset: str, accuracy: str, fires_at: int = 3) -> DataFrame:
    """Adds ``streak`` and ``off_route``: fixes farther off than max(35, accuracy), in a row; accuracy over 100 changes nothing."""
    usable = F.coalesce(F.col(accuracy), F.lit(0.0)) <= 100
    off = F.col(offset) > F.greatest(F.lit(35.0), F.coalesce(F.col(accuracy), F.lit(0.0)))
    w = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("bad", (usable & off).cast("int")).withColumn("run", F.sum((usable & ~off).cast("int")).over(w))
    streak = F.sum("bad").over(W.partitionBy(part, "run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("streak", streak).withColumn("off_route", F.col("streak") >= fires_at).drop("bad", "run")


def block_stats(raster: DataFrame, factor: int) -> DataFrame:
    """Mean, maximum and count of the values of square blocks of a (row, col, value) raster; missing values are skipped."""
    block = lambda c: F.floor(F.col(c) / factor).alias(c)
    return raster.groupBy(block("row"), block("col")).agg(F.avg("value").alias("mean"), F.max("value").alias("top"), F.count("value").alias("n"))


def keep_dense(cells: DataFrame, least: int = 4) -> DataFrame:
    """Cells (row, col) of which at least ``least`` of the 3 x 3 around are set."""
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spread = cells.select("row", "col", around.alias("o")).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    dense = spread.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return cells.join(dense, ["row", "col"])


def roof_height(samples: DataFrame, key: str, value: str, least: int = 8) -> DataFrame:
    """85th percentile to 0.1, where at least ``least`` samples are and the roof is between 2 and 150 m."""
    out = samples.groupBy(key).agg(F.percentile(value, 0.85).alias("p"), F.count(value).alias("n"))
    height = rounded(F.col("p"), 1)
    return out.select(key, "n", F.when((F.col("n") >= least) & height.between(2, 150), height).alias("height"))


#: Where a roof may be a crown above it (m, cells), the surroundings that tell so, and the lower roof seen through it.
CROWNED, MOST_CROWNED_CELLS, LEAST_RING, LEAST_DIFFS = (6.0, 40.0), 200, 12, 4
RING_SHARE, RING_HEIGHT, ROUGHNESS, LOW, FLATNESS, DENSE, REVEALED = 0.6, 0.6, 0.6, 0.15, 0.75, 0.9, 0.5
ABOVE_BOTTOM, ROOFS = 0.5, (2.0, 150.0)


def checked_roof(samples: DataFrame, bodies: DataFrame, key: str, least: int = 8) -> DataFrame:
    """key, height of every body: its roof from samples (key, value, interior), or null where they don't tell.

    The 85th percentile of the interior values (of all, if there are under ``least`` of them) to 0.1 must lie between 2 and 150 m and above the
    body's ``bottom`` by more than 0.5. ``bodies`` also has ring_n, diffs_n, ring_fraction, ring_median_m and roughness_m of the
    surroundings (null where unknown). A small body whose roof is rough, 6 to 40 m high and among plants of such a height has a
    crown above it: then the 15th percentile counts, if it is half the roof at most and passes the same limits.
    """
    inner = F.when(F.col("interior"), F.col("value"))
    low, p_inner, p_all = F.percentile("value", LOW), F.percentile(inner, 0.85), F.percentile("value", 0.85)
    told = samples.where("value IS NOT NULL").groupBy(key).agg(F.count("value").alias("n"), F.count(inner).alias("n_inner"), p_inner.alias("p_inner"), p_all.alias("p_all"), low.alias("low"))
    rows = bodies.join(told, key, "left")
    roof = rounded(F.when(F.col("n_inner") >= least, F.col("p_inner")).otherwise(F.col("p_all")), 1)
    enough = F.greatest("n_inner", "n") >= least
    fits = lambda h: (h >= ROOFS[0]) & (h > F.col("bottom") + ABOVE_BOTTOM)
    rows = rows.withColumn("roof", F.when(enough & fits(roof) & (roof <= ROOFS[1]), roof)).withColumn("lower", rounded(F.col("low"), 1))
    flat = F.col("low") > FLATNESS * F.col("roof")
    crowned = F.col("roof").between(*CROWNED) & (F.col("n") <= MOST_CROWNED_CELLS) & (F.col("ring_n") >= LEAST_RING) & (F.col("diffs_n") >= LEAST_DIFFS)
    crowned &= ~(flat & (F.col("ring_fraction") < DENSE)) & (F.col("ring_fraction") >= RING_SHARE)
    crowned &= (F.col("ring_median_m") >= RING_HEIGHT * F.col("roof")) & (F.col("roughness_m") >= ROUGHNESS)
    seen = F.when(fits(F.col("lower")) & (F.col("lower") <= REVEALED * F.col("roof")), F.col("lower"))
    return rows.select(key, F.when(F.coalesce(crowned, F.lit(False)), seen).otherwise(F.col("roof")).alias("height"))


def ranked(df: DataFrame, part: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each part."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*part).orderBy(*order))).where(F.col("place") <= most)
