"""Zones of rasters, decks and crown bases; turns and progress along routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.functions.geo import bearing, clamp, rounded, turn
from umbra.operators.routes import points_at
from umbra.operators.sequences import running_length

#: Least height (m), cells and most roughness (m) of a deck; crown window (cells), shrubs, bounds, skirts and thickness of crowns.
HIGH, DECK_CELLS, DECK_ROUGH = 2.5, 12, 0.35
WINDOW, SHRUB, SHRUB_BASE, FLOOR, LOW, HIGHEST = 2, 5.0, 0.8, 2.0, 0.2, 0.4
SKIRT_SHARE, SKIRT_CELLS, CLOSED, THIN, THIN_SHARE, LEAST_BASE = 0.6, 3, 0.3, 1.5, 0.45, 0.5
#: Window of bearings, room of a step's start, window around the last progress and the lead of a place outside it (m).
BEARING_M, SHORTEST_M, START_ROOM, BACK, AHEAD, LEAD = 12.0, 0.05, 2.0, 30.0, 150.0, 15.0


def zone_cells(rings: DataFrame, size: float, rows: int, cols: int) -> DataFrame:
    """Cells (rid, row, col) whose centre lies in the ring (rid, ring of x, y), by even-odd scan lines from the origin.

    One row per ring and scan line, then per cell: nothing is compared with cells outside the ring's box.
    """
    ends = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    ys = F.transform("ring", lambda p: p["y"])
    first = F.greatest(F.lit(0), F.ceil(F.array_min(ys) / size - 0.5).cast("int"))
    last = F.least(F.lit(rows - 1), F.floor(F.array_max(ys) / size - 0.5).cast("int"))
    lines = rings.withColumn("ends", ends).withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last))))
    y = (F.col("row") + 0.5) * size
    meets = F.zip_with("ring", "ends", lambda a, b: F.when((a["y"] <= y) != (b["y"] <= y), a["x"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"])))
    xs = lines.select("rid", "row", F.array_sort(F.filter(meets, lambda x: x.isNotNull())).alias("xs")).where(F.size("xs") > 1)
    pairs = xs.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2))))
    left = F.greatest(F.lit(0), F.ceil(F.element_at("xs", F.col("k")) / size - 0.5).cast("int"))
    right = F.least(F.lit(cols), F.floor(F.element_at("xs", F.col("k") + 1) / size - 0.5).cast("int") + 1)
    return pairs.withColumn("col", F.explode(F.when(left < right, F.sequence(left, right - 1)))).select("rid", "row", "col")


def decks(zones: DataFrame, raster: DataFrame, least: float = HIGH, cells: int = DECK_CELLS, rough: float = DECK_ROUGH) -> DataFrame:
    """Zones (rid, row, col) that are decks over a raster: enough high cells and smooth between neighbours; (rid, n, height)."""
    high = zones.join(raster.select("row", "col", "value"), ["row", "col"]).where(F.col("value") >= least)

    def beside(fixed: str, moving: str) -> Column:
        w = W.partitionBy("rid", fixed).orderBy(moving)
        return F.when(F.lead(moving).over(w) == F.col(moving) + 1, F.abs(F.lead("value").over(w) - F.col("value")))

    steps = high.withColumn("right", beside("row", "col")).withColumn("up", beside("col", "row"))
    both = steps.select("rid", "value", F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("right").alias("d")), F.struct(F.lit(False).alias("own"), F.col("up").alias("d")))).alias("s"))
    out = both.groupBy("rid").agg(F.count_if("s.own").alias("n"), F.count("s.d").alias("pairs"), F.percentile("s.d", 0.5).alias("step"), F.percentile(F.when(F.col("s.own"), F.col("value")), 0.5).alias("mid"))
    return out.where((F.col("n") >= cells) & (F.col("pairs") >= cells) & (F.col("step") <= rough)).select("rid", "n", rounded(F.col("mid"), 1).alias("height"))


def crown_base(top: Column, tree: Column, skirt: Column) -> Column:
    """Height of a crown's lower edge from its top, the tallest top around and the mean skirt (null: none seen)."""
    low = F.greatest(F.lit(FLOOR), LOW * tree)
    seen = F.least(F.greatest(low, HIGHEST * tree), F.greatest(low, SKIRT_SHARE * skirt))
    base = F.when(tree < SHRUB, SHRUB_BASE).when(skirt.isNotNull(), seen).otherwise(F.greatest(low, CLOSED * tree))
    return F.greatest(F.lit(LEAST_BASE), F.least(base, top - F.greatest(F.lit(THIN), THIN_SHARE * top)))


def crown_bases(raster: DataFrame) -> DataFrame:
    """Crown base of each cell with a top (row, col, value, skirt_sum, skirt_n); the raster lists all cells, empty ones with null.

    The square window is taken along rows, then along columns.
    """
    across = W.partitionBy("row").orderBy("col").rangeBetween(-WINDOW, WINDOW)
    along = W.partitionBy("col").orderBy("row").rangeBetween(-WINDOW, WINDOW)
    wide = raster
    for over in (across, along):
        tops = F.max("tree" if over is along else "value").over(over)
        sums = [F.sum("total" if over is along else "skirt_sum").over(over), F.sum("seen" if over is along else "skirt_n").over(over)]
        wide = wide.withColumns({"tree": tops, "total": sums[0], "seen": sums[1]})
    skirt = F.when(F.col("seen") >= SKIRT_CELLS, F.col("total") / F.col("seen"))
    return wide.where("value > 0").select("row", "col", crown_base(F.col("value"), F.col("tree"), skirt).alias("base"))


def turns(points: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Turn (part, at, angle) at every vertex between the bearings over ``BEARING_M`` before and after it, held to the ends; 0 where either is too short."""
    line = running_length(points, part, order, "x", "y").select(part, F.col("cum").alias("at"), "x", "y").dropDuplicates([part, "at"])
    # A window instead of a join with the ends: the line is made and shuffled once.
    line = line.withColumn("end", F.max("at").over(W.partitionBy(part)))
    reach = [F.greatest(F.lit(0.0), F.col("at") - BEARING_M), F.least("end", F.col("at") + BEARING_M)]
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), w.alias("w")) for k, w in enumerate(reach))))
    wish = line.select(part, "at", "x", "y", sides.alias("s")).select(part, "at", "x", "y", "s.side", "s.w")
    found = points_at(points, wish.select(part, F.col("w").alias("at")).distinct(), part, order)
    met = wish.join(found.select(part, F.col("at").alias("w"), F.struct("x", "y").alias("p")), [part, "w"])
    both = met.groupBy(part, "at").agg(*(F.min(c).alias(c) for c in "xy"), *(F.min(F.when(F.col("side") == k, F.col("p"))).alias(f"p{k}") for k in (0, 1)))
    way = lambda ax, ay, bx, by: F.when(F.hypot(bx - ax, by - ay) >= SHORTEST_M, bearing(bx - ax, by - ay))
    before, after = way(F.col("p0.x"), F.col("p0.y"), F.col("x"), F.col("y")), way(F.col("x"), F.col("y"), F.col("p1.x"), F.col("p1.y"))
    return both.select(part, "at", F.coalesce(turn(before, after), F.lit(0.0)).alias("angle"))


def snap(fixes: DataFrame, segments: DataFrame, part: str) -> DataFrame:
    """Place on its route of each fix (fid, part, px, py, hint: last progress or null): fid, along_m, offset_m.

    ``segments`` (part, seg, ax, ay, bx, by, cum). Within ``BACK`` behind and ``AHEAD`` of the hint, unless a place
    elsewhere is nearer by more than ``LEAD``; ties go to the earlier segment.
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.hypot(dx, dy)
    raw = ((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy) / (dx * dx + dy * dy)
    low, high = F.col("hint") - BACK, F.col("hint") + AHEAD
    share = lambda m: clamp((m - F.col("cum")) / length, 0.0, 1.0)
    both = fixes.join(segments, part).withColumn("len", length)
    all_t = F.when(F.col("len") == 0, 0.0).otherwise(clamp(raw, 0.0, 1.0))
    near_t = F.when(F.col("len") == 0, 0.0).otherwise(F.least(share(high), F.greatest(share(low), raw)))
    # Micrometres decide, so that the common end of two segments is a tie.
    away = lambda t: F.hypot(F.col("px") - F.col("ax") - dx * t, F.col("py") - F.col("ay") - dy * t)
    place = lambda t: F.struct(F.floor(away(t) * 1e6).alias("um"), F.col("seg"), (F.col("cum") + F.col("len") * t).alias("along_m"), away(t).alias("offset_m"))
    inside = (F.col("cum") + F.col("len") >= low) & (F.col("cum") <= high)
    best = both.groupBy("fid").agg(F.min(place(all_t)).alias("any"), F.min(F.when(inside, place(near_t))).alias("near"))
    taken = F.when(F.col("near.offset_m") <= F.col("any.offset_m") + LEAD, F.col("near")).otherwise(F.col("any"))
    return best.withColumn("s", taken).select("fid", "s.along_m", "s.offset_m")


def step_at(starts: Column, along: Column) -> Column:
    """Index of the last step that starts at ``along`` or up to ``START_ROOM`` later, never the arrival; -1 without steps."""
    begun = F.array_max(F.filter(F.transform(starts, lambda s, i: F.when(s <= along + START_ROOM, i)), lambda i: i.isNotNull()))
    return F.when(F.size(starts) == 0, -1).otherwise(F.least(F.coalesce(begun, F.lit(0)), F.greatest(F.lit(0), F.size(starts) - 2)))
