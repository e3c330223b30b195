"""Checks of request values as Column expressions: null is what a request would be turned down for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A moment with its offset; decimal numbers.
MOMENT = r"(?i)^\d{4}-\d{2}-\d{2}T(?:(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?|24:00(?::00(?:\.0+)?)?)(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)$"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def moment(raw: Column) -> Column:
    """Trimmed text of a moment with an offset whose day is in the calendar."""
    text = F.trim(raw)
    return F.when(text.rlike(MOMENT) & F.substring(text, 1, 10).try_cast("date").isNotNull(), text)


def bounds(raw: Column) -> Column:
    """West, south, east and north of ``w,s,e,n`` as an array of doubles; an empty part is 0; west before east, south before north, latitudes to 90."""
    parts = F.transform(F.split(raw, ",", -1), lambda p: F.when(F.trim(p) == "", 0.0).when(F.trim(p).rlike(NUMBER), F.trim(p).try_cast("double")))
    west, south, east, north = (F.get(parts, F.lit(i)) for i in range(4))
    finite = F.forall(parts, lambda p: p.isNotNull() & (F.abs(p) < float("inf")))
    return F.when((F.size(parts) == 4) & finite & (west < east) & (south < north) & (F.abs(south) <= 90) & (F.abs(north) <= 90), parts)


def one_of(raw: Column, allowed: list[str], otherwise: str) -> Column:
    """The value if it is allowed, ``otherwise`` for a missing one."""
    return F.when(raw.isNull(), F.lit(otherwise)).when(raw.isin(allowed), raw)


def number_in(raw: Column, low: float, high: float) -> Column:
    """The number if it is within both bounds; not a number is none."""
    return F.when(~F.isnan(raw) & raw.between(low, high), raw)
