"""Which rows of an ordered group are kept: places along a route, thinned options, first of equal routes, running starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def along_route(spots: DataFrame, part: str, order: list[str], along: str, most: int = 12) -> DataFrame:
    """The first ``most`` spots of each route by ``order``, with their ``place`` along it."""
    kept = spots.withColumn("place", F.row_number().over(W.partitionBy(part).orderBy(*order))).where(F.col("place") <= most)
    return kept.withColumn("place", F.row_number().over(W.partitionBy(part).orderBy(along, *order)))


def thinned(options: DataFrame, part: str, order: list[str], score: str, most: int = 16) -> DataFrame:
    """At most ``most`` options of each part: evenly spread ones with both ends, and the best (earliest of equals)."""
    w = W.partitionBy(part).orderBy(*order)
    numbered = options.withColumn("at", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(part)))
    best = numbered.withColumn("best", F.min_by("at", F.struct(-F.col(score), F.col("at"))).over(W.partitionBy(part)))
    spread = F.exists(F.sequence(F.lit(0), F.lit(most - 2)), lambda k: F.floor(k * (F.col("n") - 1) / (most - 2) + 0.5) == F.col("at"))
    return best.where((F.col("n") <= most) | spread | (F.col("at") == F.col("best"))).drop("n", "best")


def distinct_routes(routes: DataFrame, part: str, path: str, order: str) -> DataFrame:
    """Of a part's routes along the same path the first by ``order``."""
    rest = [c for c in routes.columns if c not in (part, path)]
    return routes.groupBy(part, path).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row")).select(part, path, "row.*")


def chosen_route(routes: DataFrame, part: str, profile: str, order: str, chosen: Column) -> DataFrame:
    """Each part's route of the chosen profile, else the balanced one, else the first."""
    rest = [c for c in routes.columns if c != part]
    rank = F.when(F.col(profile) == chosen, 0).when(F.col(profile) == "balanced", 1).otherwise(2)
    return routes.groupBy(part).agg(F.min_by(F.struct(*rest), F.struct(rank, F.col(order))).alias("row")).select(part, "row.*")


def step_starts(steps: DataFrame, points: DataFrame, part: str, order: str, index: str) -> DataFrame:
    """Adds ``start_m``: where each step begins, never before the step before. points: part, at (from 0), cum."""
    last = points.groupBy(part).agg(F.max("at").alias("last"))
    at = F.greatest(F.lit(0), F.least(F.col("last"), F.floor(F.col(index) + 0.5))).cast("int")
    met = steps.join(last, part, "left").withColumn("at", at).join(points.select(part, "at", "cum"), [part, "at"], "left")
    start = F.max(F.coalesce("cum", F.lit(0.0))).over(W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return met.withColumn("start_m", start).drop("at", "last", "cum")


def kerb_weights(nodes: DataFrame, kerbs: DataFrame, part: str, seq: str, node: str) -> DataFrame:
    """part, kerbs: raised kerbs on each line, those at its ends by half."""
    w = W.partitionBy(part)
    ends = (F.col(seq) == F.min(seq).over(w)) | (F.col(seq) == F.max(seq).over(w))
    met = nodes.withColumn("share", F.when(ends, 0.5).otherwise(1.0)).join(kerbs.select(node).distinct().withColumn("raised", F.lit(True)), node, "left")
    return met.groupBy(part).agg(F.sum(F.when(F.col("raised"), F.col("share")).otherwise(0.0)).alias("kerbs"))


def union_grid(grids: DataFrame, part: str, cell_m: float) -> DataFrame:
    """Smallest grid around each part's grids (x0, y0, cols, rows, cell_m)."""
    far = lambda start, n: F.max(F.col(start) + F.col(n) * F.col("cell_m"))
    box = grids.groupBy(part).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), far("x0", "cols").alias("x1"), far("y0", "rows").alias("y1"))
    size = lambda low, high: F.floor((F.col(high) - F.col(low)) / cell_m + 0.5)
    return box.select(part, "x0", "y0", size("x0", "x1").alias("cols"), size("y0", "y1").alias("rows"))
