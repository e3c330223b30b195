"""Polylines and rings as arrays of (x, y) structs, boxes and grids as Column expressions. Null input gives null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.geo import AREA, CENTRE_LAT, CENTRE_LON, TILE_LAT, TILE_LON

#: Metres per degree of latitude and of longitude at the equator as clients count them; arrival and off-route limits (m).
CLIENT_LAT_M, CLIENT_LON_M = 110_540.0, 111_320.0
ARRIVAL_M, OFF_ROUTE_M = 15.0, 35.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _pairs(line: Column, of) -> Column:
    """``of`` applied to each two points that follow each other."""
    rest = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    return F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), rest, of)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def length(line: Column) -> Column:
    """Length of a polyline; 0 for fewer than two points."""
    return _total(_pairs(line, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))


def append(line: Column, more: Column) -> Column:
    """``more`` after ``line``, without its first point where that repeats the line's last."""
    joint = F.try_element_at(line, F.lit(-1)) == F.try_element_at(more, F.lit(1))
    return F.concat(line, F.when(joint, F.slice(more, 2, F.greatest(F.size(more), F.lit(1)))).otherwise(more))


def cleaned(line: Column) -> Column:
    """Without null points and without points equal to the one before."""
    kept = F.filter(line, lambda p: p.isNotNull())
    return F.filter(kept, lambda p, i: (i == 0) | ~F.get(kept, i - 1).eqNullSafe(p))


def densified(line: Column, step: float) -> Column:
    """Points added so that none is farther than ``step`` from the one before."""

    def cut(a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        parts = F.greatest(F.lit(1), F.ceil(F.hypot(dx, dy) / step).cast("int"))
        return F.transform(F.sequence(F.lit(1), parts), lambda k: point(a["x"] + dx * k / parts, a["y"] + dy * k / parts))

    return F.concat(F.slice(line, 1, 1), F.flatten(_pairs(line, cut)))


def pairs_of(flat: Column) -> Column:
    """Points of a flat list x, y, x, y, ...; a last number without partner goes."""
    half = F.floor(F.size(flat) / 2).cast("int")
    return F.when(half > 0, F.transform(F.sequence(F.lit(0), F.greatest(half, F.lit(1)) - 1), lambda i: point(F.get(flat, 2 * i), F.get(flat, 2 * i + 1)))).when(flat.isNotNull(), F.array().cast("array<struct<x:double,y:double>>"))


def mean_point(line: Column) -> Column:
    """Mean of the points; (0, 0) without points."""
    n = F.greatest(F.size(line), F.lit(1))
    return point(_total(F.transform(line, lambda p: p["x"])) / n, _total(F.transform(line, lambda p: p["y"])) / n)


def closed_area(ring: Column) -> Column:
    """Area of a ring whose last point repeats its first."""
    return F.abs(_total(_pairs(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))) / 2


def centroid(ring: Column) -> Column:
    """Centroid of a ring whose last point repeats its first; the mean of its points where it has no area."""
    origin = F.try_element_at(ring, F.lit(1))
    moved = F.transform(ring, lambda p: point(p["x"] - origin["x"], p["y"] - origin["y"]))
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    twice = _total(_pairs(moved, cross))
    at = lambda axis: origin[axis] + _total(_pairs(moved, lambda a, b: (a[axis] + b[axis]) * cross(a, b))) / (3 * twice)
    return F.when(F.abs(twice) < 1e-6, mean_point(ring)).otherwise(point(at("x"), at("y")))


def client_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Local metres around a route's first point, as clients count them."""
    return point((lon - lon0) * CLIENT_LON_M * F.cos(F.radians(lat0)), (lat - lat0) * CLIENT_LAT_M)


def circle(lat: Column, lon: Column, radius_m: Column, vertices: int = 48) -> Column:
    """Closed ring (lon as x, lat as y) around a position."""

    def vertex(i):
        angle = i / F.lit(float(vertices)) * (2 * math.pi)
        return point(lon + F.cos(angle) * radius_m / (F.cos(F.radians(lat)) * CLIENT_LON_M), lat + F.sin(angle) * radius_m / CLIENT_LAT_M)

    return F.transform(F.sequence(F.lit(0), F.lit(vertices)), vertex)


def clamped_box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The part of a box inside the service area; null for a box that is no box or lies outside."""
    w, s = F.greatest(west, F.lit(AREA[0])), F.greatest(south, F.lit(AREA[1]))
    e, n = F.least(east, F.lit(AREA[2])), F.least(north, F.lit(AREA[3]))
    given = west.isNotNull() & south.isNotNull() & east.isNotNull() & north.isNotNull()
    return F.when(given & (west <= east) & (south <= north) & (w <= e) & (s <= n), F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north")))


def aligned_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Box rounded outward to whole metres."""
    return F.struct(F.floor(x0).alias("x0"), F.floor(y0).alias("y0"), F.ceil(x1).alias("x1"), F.ceil(y1).alias("y1"))


def owned_cells(low: Column, high: Column, cell_m: float) -> Column:
    """Half-open range of the cells whose centres lie in [low, high)."""
    return F.struct(F.ceil(low / cell_m - 0.5).alias("begin"), F.ceil(high / cell_m - 0.5).alias("end"))


def centre_distance(ix: Column, iy: Column) -> Column:
    """Squared distance of a tile's middle from the service centre, in degrees of latitude."""
    d_lat, d_lon = (iy + 0.5) * TILE_LAT - CENTRE_LAT, ((ix + 0.5) * TILE_LON - CENTRE_LON) * math.cos(math.radians(CENTRE_LAT))
    return d_lat * d_lat + d_lon * d_lon


def utm_zone(epsg: Column) -> Column:
    """Zone and hemisphere of a UTM code; null for any other."""
    north, south = epsg.between(32601, 32660), epsg.between(32701, 32760)
    return F.when(north | south, F.struct((epsg - F.when(north, 32600).otherwise(32700)).alias("zone"), south.alias("south")))


def tile_of_key(key: Column) -> Column:
    """Tile address of a key ``ix_iy``; null for any other text."""
    part = lambda i: F.regexp_extract(key, r"^(-?\d+)_(-?\d+)$", i)
    return F.when(part(1) != "", F.struct(part(1).cast("long").alias("ix"), part(2).cast("long").alias("iy")))


def service_message(message: Column) -> Column:
    """Without a last remark in square brackets."""
    return F.regexp_replace(message, r"\s*\[[^\]]*\]\s*$", "")


def arrived(remaining_m: Column, offset_m: Column, direct_m: Column) -> Column:
    """At the end: close to the destination, or close to the route's end and on it."""
    return (direct_m <= ARRIVAL_M) | ((remaining_m <= ARRIVAL_M) & (offset_m <= OFF_ROUTE_M))
