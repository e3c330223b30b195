"""Planar geometry and projection as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius (m), service centre and service area (west, south, east, north), tile steps in degrees.
EARTH_M, CENTRE_LAT, CENTRE_LON = 6371008.8, 50.0614, 19.9372
AREA = (19.78, 49.96, 20.22, 50.13)
TILE_LON, TILE_LAT, TILE_EPS = 0.03, 0.02, 1e-9

METRES_PER_DEGREE = EARTH_M * math.pi / 180
LON_METRES = METRES_PER_DEGREE * math.cos(math.radians(CENTRE_LAT))


def rounded(x: Column, digits: int = 0) -> Column:
    """Half towards plus infinity at ``digits`` decimals."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / F.lit(scale)


def clamp(x: Column, low: float, high: float) -> Column:
    """Between both bounds; null stays null (least and greatest would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def to_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Local metres east and north of the centre."""
    return (lon - CENTRE_LON) * LON_METRES, (lat - CENTRE_LAT) * METRES_PER_DEGREE


def to_lat_lon(x: Column, y: Column) -> tuple[Column, Column]:
    return y / METRES_PER_DEGREE + CENTRE_LAT, x / LON_METRES + CENTRE_LON


def tile_of(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Half-open tile address (ix, iy)."""
    return F.floor(lon / TILE_LON + TILE_EPS), F.floor(lat / TILE_LAT + TILE_EPS)


def in_area(lat: Column, lon: Column) -> Column:
    return lon.between(AREA[0], AREA[2]) & lat.between(AREA[1], AREA[3])


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def compass(angle: Column) -> Column:
    """Index 0 to 7 of the compass point nearest to a bearing."""
    return F.pmod(F.floor(angle / 45 + 0.5), F.lit(8))


def turn(before: Column, after: Column) -> Column:
    """Signed turn in (-180, 180]."""
    raw = F.pmod(after - before, F.lit(360.0))
    return F.when(raw > 180, raw - 360).otherwise(raw)


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Share of segment a-b at which it is nearest to p, 0 for a segment without length."""
    length2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    dot = (px - ax) * (bx - ax) + (py - ay) * (by - ay)
    return F.when(length2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / length2)))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = along(px, py, ax, ay, bx, by)
    return F.hypot(ax + t * (bx - ax) - px, ay + t * (by - ay) - py)


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of an array of (x, y) structs; the ring closes itself."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, shifted, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(crosses, F.lit(0.0), lambda s, c: s + c) / 2


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test against an array of (x, y) structs."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    hits = F.zip_with(
        ring, shifted, lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0)
    )
    return F.aggregate(hits, F.lit(0), lambda s, h: s + h) % 2 == 1
