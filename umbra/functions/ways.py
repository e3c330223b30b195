"""What tags say of buildings, trees and ways, as Column expressions over a map of tags; a missing key is a null value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions import tags as rules
from umbra.functions.geo import clamp, rounded
from umbra.functions.text import clean_value, parse_count, parse_incline, parse_metres

#: Metres of a storey and of a roof, heights where tags say none, crown radius by height.
STOREY_M, ROOF_M, BUILDING_M, TREE_M, CANOPY_M, CROWN_SHARE = 3.0, 1.5, 10.0, 10.0, 15.0, 0.35
#: Heights by kind of building.
HEIGHTS = {
    "garage": 3.0, "garages": 3.0, "shed": 3.0, "kiosk": 3.0, "hut": 3.0, "carport": 3.0, "roof": 4.0, "service": 4.0, "greenhouse": 4.0, "bungalow": 5.0,
    "house": 8.0, "detached": 8.0, "semidetached_house": 8.0, "terrace": 8.0, "chapel": 12.0, "school": 12.0, "university": 15.0, "hospital": 15.0,
    "office": 15.0, "hotel": 18.0, "apartments": 18.0, "church": 25.0, "cathedral": 25.0, "basilica": 25.0,
}
#: Fixed values of road classes: offset of the walker from the axis, penalty where a sidewalk is not known, and where there is none.
ROADS = {
    "primary": (8.0, 1.8, 2.5),
    "secondary": (7.0, 1.8, 2.5),
    "tertiary": (5.5, 1.4, 2.5),
    "residential": (4.0, 1.1, 1.1),
    "unclassified": (4.0, 1.1, 1.1),
    "road": (4.0, 1.1, 1.1),
    "service": (2.5, 1.1, 1.1),
}
#: Roads left out where sidewalks are ways of their own; lanes, kerb, steps, cycleways, driveways.
LEFT_OUT = ("primary", "secondary", "tertiary", "residential", "unclassified")
LANE_M, KERB_M, STEPS_SPEED, STEPS_PENALTY, CYCLEWAY_PENALTY, DRIVEWAY_PENALTY = 3.2, 1.0, 0.5, 1.2, 1.5, 1.25
MIST = r"(?iu)kurtyn\p{L}* wodn|zamgławiacz|mgiełk"
DRINKING = ("drinking", "bubbler", "bottle_refill")

_tag = rules.tag


def _among(value: Column, *values: str) -> Column:
    return F.coalesce(value.isin(*values), F.lit(False))


def _look_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def building_heights(tags: Column) -> Column:
    """height and min_height (m, to the centimetre): by height, else storeys, else kind; never below the lower edge."""
    storeys = parse_count(_tag(tags, "building:min_level")) * STOREY_M
    low = clamp(F.coalesce(parse_metres(_tag(tags, "min_height")), storeys, F.lit(0.0)), 0.0, 300.0)
    explicit = F.coalesce(parse_metres(_tag(tags, "height")), parse_metres(_tag(tags, "building:height")))
    levels = parse_count(_tag(tags, "building:levels"))
    under_roof = F.greatest(F.lit(0.0), F.coalesce(parse_count(_tag(tags, "roof:levels")), F.lit(0.0)))
    kind = F.coalesce(_tag(tags, "building"), _tag(tags, "building:part"), F.lit("yes"))
    height = F.when(explicit > 0, explicit).when(levels > 0, (levels + under_roof) * STOREY_M + ROOF_M)
    height = clamp(height.otherwise(F.coalesce(_look_up(HEIGHTS, kind), F.lit(BUILDING_M))), 2.0, 300.0)
    return F.struct(rounded(F.when(height <= low, low + STOREY_M).otherwise(height), 2).alias("height"), rounded(low, 2).alias("min_height"))


def tree_size(tags: Column) -> Column:
    """height and crown radius (m): half the crown's diameter, else a share of the height."""
    height = clamp(F.coalesce(parse_metres(_tag(tags, "height")), F.lit(TREE_M)), 2.0, 40.0)
    across = parse_metres(_tag(tags, "diameter_crown"))
    radius = clamp(F.when(across > 0, across / 2).otherwise(height * CROWN_SHARE), 1.0, 12.0)
    return F.struct(rounded(height, 2).alias("height"), rounded(radius, 2).alias("radius"))


def canopy_height(tags: Column) -> Column:
    return rounded(clamp(F.coalesce(parse_metres(_tag(tags, "height")), F.lit(CANOPY_M)), 3.0, 45.0), 2)


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once, however often ``make`` names it."""
    return F.transform(F.array(value), make)[0]


def _side(value: Column) -> Column:
    """yes, no or separate of what a tag says of one side."""
    return F.when(value == "separate", "separate").when(value.isin("no", "none"), "no").when(value.isNotNull(), "yes")


def sidewalk_sides(tags: Column) -> tuple[Column, Column]:
    """What is known of the left and the right sidewalk; a tag of one side outdoes that of both, which outdoes the plain one."""
    plain = _tag(tags, "sidewalk")
    whole = F.when(plain.isin("both", "yes"), "yes").when(plain.isin("no", "none"), "no").when(plain == "separate", "separate")
    both = _side(_tag(tags, "sidewalk:both"))
    left = whole.when(plain == "left", "yes").when(plain == "right", "no")
    right = whole.when(plain == "right", "yes").when(plain == "left", "no")
    return F.coalesce(_side(_tag(tags, "sidewalk:left")), both, left), F.coalesce(_side(_tag(tags, "sidewalk:right")), both, right)


def sidewalk(left: Column, right: Column) -> Column:
    """Both sides in one word."""
    at_left, at_right = _among(left, "yes"), _among(right, "yes")
    word = F.when(at_left & at_right, "both").when(at_left, "left").when(at_right, "right")
    word = word.when(_among(left, "separate") | _among(right, "separate"), "separate")
    return word.when(_among(left, "no") & _among(right, "no"), "no").otherwise("unknown")


def side_offset(tags: Column, otherwise: Column) -> Column:
    """Metres from the axis to where one walks: by width, else lanes, else what the class says."""
    across = F.struct(parse_metres(_tag(tags, "width")).alias("width"), parse_count(_tag(tags, "lanes")).alias("lanes"))
    beside = lambda m: clamp(m / 2 + KERB_M, 2.0, 15.0)
    return once(across, lambda a: F.when(a["width"] > 0, beside(a["width"])).when(a["lanes"] > 0, beside(a["lanes"] * LANE_M)).otherwise(otherwise))


def classify(tags: Column) -> Column:
    """kind, covered, sidewalk, side_offset_m, penalty, speed_factor of a way that one may walk; null for all others."""
    return once(tags, lambda t: F.when(rules.may_walk(t), _of_walkable(t)))


def _of_walkable(tags: Column) -> Column:
    left, right = sidewalk_sides(tags)
    highway = _tag(tags, "highway")
    known = F.struct(highway.alias("highway"), F.regexp_replace(highway, "_link$", "").alias("name"), left.alias("left"), right.alias("right"))
    return once(known, lambda k: once(sidewalk(k["left"], k["right"]), lambda beside: _classified(tags, k["highway"], k["name"], k["left"], k["right"], beside)))


def _classified(tags: Column, highway: Column, name: Column, left: Column, right: Column, beside: Column) -> Column:
    road = F.coalesce(name.isin(*ROADS), F.lit(False))
    offset, unknown, none = (_look_up({k: v[i] for k, v in ROADS.items()}, name) for i in range(3))
    usable = lambda side: side.isNull() | (side == "yes")
    elsewhere = name.isin(*LEFT_OUT) & (beside == "separate") & ~usable(left) & ~usable(right)
    kind = F.when(highway == "footway", F.when(_among(_tag(tags, "footway"), "sidewalk", "crossing"), _tag(tags, "footway")).otherwise("footway"))
    kind = kind.when(highway.isin("steps", "pedestrian", "cycleway"), highway)
    kind = kind.when(highway.isin("path", "track", "bridleway"), F.when(_among(_tag(tags, "path"), "crossing"), "crossing").otherwise("path"))
    kind = kind.when((highway == "living_street") | (road & ~elsewhere), "street")
    by_side = F.when(beside.isin("both", "left", "right"), 1.0).when(beside == "no", none).otherwise(unknown)
    drive = _among(_tag(tags, "service"), "driveway", "parking_aisle")
    expected = _among(_tag(tags, "foot"), *rules.FOOT_ALLOWED) | _among(_tag(tags, "segregated"), "yes", "no")
    penalty = F.when(highway == "steps", STEPS_PENALTY).when((highway == "cycleway") & ~expected, CYCLEWAY_PENALTY)
    penalty = penalty.when(road, F.when(drive, F.greatest(by_side, F.lit(DRIVEWAY_PENALTY))).otherwise(by_side)).otherwise(1.0)
    covered = rules.is_covered(tags)
    made = F.struct(
        F.when(covered, "covered").otherwise(kind).alias("kind"),
        covered.alias("covered"),
        beside.alias("sidewalk"),
        F.when(road & ~covered, rounded(side_offset(tags, offset), 2)).otherwise(0.0).alias("side_offset_m"),
        penalty.alias("penalty"),
        F.when(highway == "steps", STEPS_SPEED).otherwise(1.0).alias("speed_factor"),
    )
    return F.when(kind.isNotNull(), made)


def _walked(tags: Column, key: str, street: Column) -> Column:
    """A tag of where one walks: on a street those of its sidewalks come first."""
    own = [clean_value(_tag(tags, f"{prefix}:{key}")) for prefix in ("sidewalk", "sidewalk:both", "sidewalk:left", "sidewalk:right", "footway")]
    return F.coalesce(F.when(street, F.coalesce(*own)), clean_value(_tag(tags, key)))


def attributes(tags: Column, kind: Column) -> Column:
    """surface, smoothness, wheelchair, incline_pct, ramp, lit; null where nothing is known."""
    wheels, lit = clean_value(_tag(tags, "wheelchair")), clean_value(_tag(tags, "lit"))
    ramps = [_among(_tag(tags, key), "yes", "separate") for key in ("ramp", "ramp:wheelchair", "ramp:stroller")]
    street = F.coalesce(kind == "street", F.lit(False))
    return F.struct(
        _walked(tags, "surface", street).alias("surface"),
        _walked(tags, "smoothness", street).alias("smoothness"),
        F.when(wheels.isin("yes", "designated"), "yes").when(wheels.isin("limited", "no"), wheels).alias("wheelchair"),
        parse_incline(_tag(tags, "incline")).alias("incline_pct"),
        F.when(_among(_tag(tags, "highway"), "steps") & (ramps[0] | ramps[1] | ramps[2]), True).alias("ramp"),
        F.when(lit.isNotNull(), ~lit.isin("no", "disused")).alias("lit"),
    )


def cool_spot_kind(tags: Column, areal: Column) -> Column:
    """What a place offers on a hot day; null for nothing, or for what only some may use."""
    amenity, made = _tag(tags, "amenity"), _tag(tags, "man_made")
    fountain, drinkable = _tag(tags, "fountain"), _tag(tags, "drinking_water")
    water = _among(amenity, "fountain", "drinking_water", "water_point") | _among(made, "water_tap", "drinking_fountain")
    said = F.concat_ws(" ", F.coalesce(_tag(tags, "name"), F.lit("")), F.coalesce(_tag(tags, "description"), F.lit("")))
    mist = said.rlike(MIST) & (water | (~areal & _tag(tags, "highway").isNull()))
    garden = _among(_tag(tags, "leisure"), "park", "garden") & areal
    closed = _among(_tag(tags, "garden:type"), "residential", "private") & (F.coalesce(_tag(tags, "name"), F.lit("")) == "")
    kind = F.when(_among(_tag(tags, "access"), "private", "no"), None)
    kind = kind.when((_among(amenity, "fountain") & _among(fountain, "mist", "misting")) | mist, "water_mist")
    kind = kind.when(_among(amenity, "drinking_water", "water_point") | _among(made, "drinking_fountain"), "drinking_water")
    kind = kind.when(_among(made, "water_tap"), F.when(~_among(drinkable, "no"), "drinking_water"))
    kind = kind.when(_among(amenity, "fountain"), F.when(_among(drinkable, "yes") | _among(fountain, *DRINKING), "drinking_water").otherwise("fountain"))
    return kind.when(_among(amenity, "bench", "shelter"), amenity).when(garden & ~closed, "park")
