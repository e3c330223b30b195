"""Queries of way, building and cost rules over tagged stand-ins, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import costs, tags, ways
from umbra.plans.registry import query, stand_in


def _pick(by: str, values: list[str | None]) -> str:
    """A CASE that gives one of the values by a number's remainder."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {by} % {len(values)} {cases} END"


def _table(table: str, key: str, columns: dict[str, list[str | None]], also: str = "") -> str:
    parts = [f"{_pick(f'(({key} * {31 + 6 * i}) % 9973)', values)} AS {name}" for i, (name, values) in enumerate(columns.items())]
    return f"SELECT {key} AS id, {', '.join(parts)}{also} FROM {table}"


def _tagged(read, table: str, statement: str, keys: dict[str, str]) -> DataFrame:
    rows = stand_in(read, table, statement)
    return rows.withColumn("tags", F.create_map(*(x for k, c in keys.items() for x in (F.lit(k), F.col(c)))))


_R2, _R1 = "floor(({}) * 100 + 0.5) / 100", "floor(({}) * 10 + 0.5) / 10"

# --- buildings and trees ---------------------------------------------------------------------------------------
HOUSES = _table("part", "p_partkey", {
    "height": ["12", None, "7,5 m", None, "0", "high", None, "400"], "levels": [None, "4", "0", "2,5", "x", None], "roof": [None, "1", "-2", ""],
    "low": [None, None, "3", "50 ft", None], "low_level": [None, "2", None], "kind": ["yes", "garage", "church", "hotel", None, "stall"], "crown": [None, "6", "0", "50", "2 m"],
})
_HOUSE_KEYS = {"height": "height", "building:levels": "levels", "roof:levels": "roof", "min_height": "low", "building:min_level": "low_level", "building": "kind", "diameter_crown": "crown"}
_H = "CASE height WHEN '12' THEN 12.0 WHEN '7,5 m' THEN 7.5 WHEN '0' THEN 0.0 WHEN '400' THEN 400.0 END::DOUBLE"
_LOW = "CASE low WHEN '3' THEN 3.0::DOUBLE WHEN '50 ft' THEN 50 * 0.3048::DOUBLE ELSE coalesce(low_level::DOUBLE * 3, 0) END"
_LEVELS = "CASE levels WHEN '4' THEN 4.0 WHEN '0' THEN 0.0 WHEN '2,5' THEN 2.5 END::DOUBLE"
_ROOF = "CASE roof WHEN '1' THEN 1 ELSE 0 END"


@query("prj_10_building_heights", f"""SELECT id, {_R2.format('CASE WHEN h <= low THEN low + 3 ELSE h END')} AS height, {_R2.format('low')} AS min_height FROM (SELECT id, {_LOW} AS low,
    least(300.0, greatest(2.0, CASE WHEN {_H} > 0 THEN {_H} WHEN {_LEVELS} > 0 THEN ({_LEVELS} + {_ROOF}) * 3 + 1.5
    ELSE CASE kind WHEN 'garage' THEN 3.0 WHEN 'church' THEN 25.0 WHEN 'hotel' THEN 18.0 ELSE 10.0 END::DOUBLE END)) AS h FROM ({HOUSES}))""")
def _(read):
    return _tagged(read, "part", HOUSES, _HOUSE_KEYS).select("id", ways.building_heights(F.col("tags")).alias("h")).select("id", "h.*")


_TREE = f"least(40.0, greatest(2.0, coalesce({_H}, 10.0)))"
_CROWN = "CASE crown WHEN '6' THEN 3.0 WHEN '50' THEN 25.0 WHEN '2 m' THEN 1.0 END::DOUBLE"


@query("prj_12_tree_size", f"SELECT id, {_R2.format(_TREE)} AS height, {_R2.format(f'least(12.0, greatest(1.0, coalesce({_CROWN}, {_TREE} * 0.35::DOUBLE)))')} AS radius FROM ({HOUSES})")
def _(read):
    return _tagged(read, "part", HOUSES, _HOUSE_KEYS).select("id", ways.tree_size(F.col("tags")).alias("t")).select("id", "t.*")


@query("prj_11_canopy_height", f"SELECT id, {_R2.format(f'least(45.0, greatest(3.0, coalesce({_H}, 15.0)))')} AS height FROM ({HOUSES})")
def _(read):
    return _tagged(read, "part", HOUSES, _HOUSE_KEYS).select("id", ways.canopy_height(F.col("tags")).alias("height"))


# --- ways --------------------------------------------------------------------------------------------------------
WAYS = _table("orders", "o_orderkey", {
    "highway": ["footway", "steps", "pedestrian", "path", "cycleway", "living_street", "primary", "secondary_link", "tertiary", "residential", "service", "motorway", None],
    "sidewalk": [None, "both", "left", "right", "no", "separate", "yes", "odd"], "side_both": [None, None, None, "separate", "none"], "side_left": [None, None, "yes", "no", "separate", None],
    "side_right": [None, None, None, "no", "separate"], "foot": [None, None, "yes", "no", None, None, "designated"], "access": [None, None, None, "private"],
    "footway": [None, "sidewalk", "crossing", "link"], "segregated": [None, "yes", None], "service": [None, "driveway", None], "width": [None, None, "9", "60", "narrow"],
    "lanes": [None, "2", None, "0"], "tunnel": [None, None, None, None, None, "yes"], "surface": [None, "Sett; x", "gravel", None], "own_surface": [None, None, "asphalt"],
    "smoothness": [None, "good", "bad", "horrible", None], "wheelchair": [None, "designated", "limited", "no", "maybe"], "incline": [None, "5%", "up", "-8 %", "10°", "steep", "90 deg", "12,34"],
    "ramp": [None, "yes", "no"], "lit": [None, "24/7", "no"],
})
_WAY_KEYS = {c: c for c in ("highway", "sidewalk", "foot", "access", "footway", "segregated", "service", "width", "lanes", "tunnel", "surface", "smoothness", "wheelchair", "incline", "ramp", "lit")}
_WAY_KEYS |= {"sidewalk:both": "side_both", "sidewalk:left": "side_left", "sidewalk:right": "side_right", "sidewalk:surface": "own_surface"}
_SIDED = "CASE {0} WHEN 'none' THEN 'no' ELSE {0} END"
_SIDES = f"""SELECT *, coalesce({_SIDED.format('side_left')}, {_SIDED.format('side_both')}, CASE WHEN sidewalk IN ('both', 'yes', 'left') THEN 'yes' WHEN sidewalk IN ('no', 'right') THEN 'no' WHEN sidewalk = 'separate' THEN sidewalk END) AS l,
    coalesce({_SIDED.format('side_right')}, {_SIDED.format('side_both')}, CASE WHEN sidewalk IN ('both', 'yes', 'right') THEN 'yes' WHEN sidewalk IN ('no', 'left') THEN 'no' WHEN sidewalk = 'separate' THEN sidewalk END) AS r,
    CASE WHEN foot = 'no' OR (foot IS NULL AND access = 'private') THEN NULL ELSE highway END AS way FROM ({WAYS})"""
_BESIDE = """CASE WHEN l = 'yes' AND r = 'yes' THEN 'both' WHEN l = 'yes' THEN 'left' WHEN r = 'yes' THEN 'right' WHEN l = 'separate' OR r = 'separate' THEN 'separate' WHEN l = 'no' AND r = 'no' THEN 'no' ELSE 'unknown' END"""
_CLASSES = "(VALUES ('primary', 8.0, 1.8, 2.5), ('secondary_link', 7.0, 1.8, 2.5), ('tertiary', 5.5, 1.4, 2.5), ('residential', 4.0, 1.1, 1.1), ('service', 2.5, 1.1, 1.1)) c(road, off_m, unknown, without)"


@query("prj_15_sidewalk", f"SELECT id, l AS left_side, r AS right_side, {_BESIDE} AS word FROM ({_SIDES})")
def _(read):
    left, right = ways.sidewalk_sides(F.col("tags"))
    return _tagged(read, "orders", WAYS, _WAY_KEYS).select("id", left.alias("left_side"), right.alias("right_side"), ways.sidewalk(left, right).alias("word"))


_OFFSET = "CASE width WHEN '9' THEN 5.5 WHEN '60' THEN 15.0 ELSE CASE WHEN lanes = '2' THEN 4.2 ELSE coalesce(off_m, 1.0) END END::DOUBLE"


@query("prj_16_side_offset", f"SELECT id, {_R2.format(_OFFSET)} AS offset_m FROM ({WAYS}) LEFT JOIN {_CLASSES} ON highway = road")
def _(read):
    default = F.try_element_at(F.create_map(*(F.lit(x) for k, v in ways.ROADS.items() for x in (k, v[0]))), F.regexp_replace("highway", "_link$", ""))
    offset = ways.side_offset(F.col("tags"), F.coalesce(default, F.lit(1.0)))
    return _tagged(read, "orders", WAYS, _WAY_KEYS).select("id", (F.floor(offset * 100 + 0.5) / 100).alias("offset_m"))


@query("prj_14_classify", f"""WITH s AS (SELECT *, {_BESIDE} AS sidewalk_word FROM ({_SIDES}) LEFT JOIN {_CLASSES} ON way = road),
    k AS (SELECT *, CASE WHEN way = 'footway' THEN CASE WHEN footway IN ('sidewalk', 'crossing') THEN footway ELSE 'footway' END WHEN way IN ('steps', 'pedestrian', 'path', 'cycleway') THEN way
    WHEN way = 'living_street' THEN 'street' WHEN road IS NOT NULL AND NOT (road <> 'service' AND sidewalk_word = 'separate' AND l IS NOT NULL AND r IS NOT NULL) THEN 'street' END AS plain FROM s)
    SELECT id, CASE WHEN tunnel = 'yes' THEN 'covered' ELSE plain END AS kind, coalesce(tunnel = 'yes', false) AS covered, sidewalk_word AS sidewalk,
    CASE WHEN road IS NULL OR tunnel = 'yes' THEN 0.0 ELSE {_R2.format(_OFFSET)} END::DOUBLE AS side_offset_m,
    CASE WHEN way = 'steps' THEN 1.2 WHEN way = 'cycleway' AND foot IS NULL AND segregated IS NULL THEN 1.5 WHEN road IS NULL THEN 1.0 ELSE greatest(CASE WHEN service = 'driveway' THEN 1.25 ELSE 1.0 END,
    CASE WHEN sidewalk_word IN ('both', 'left', 'right') THEN 1.0 WHEN sidewalk_word = 'no' THEN without ELSE unknown END) END::DOUBLE AS penalty,
    CASE WHEN way = 'steps' THEN 0.5 ELSE 1.0 END::DOUBLE AS speed_factor FROM k WHERE plain IS NOT NULL""")
def _(read):
    # Behind the generator no way is worked out again for its test or its fields.
    walked = F.explode(F.filter(F.array(ways.classify(F.col("tags"))), lambda way: way.isNotNull()))
    return _tagged(read, "orders", WAYS, _WAY_KEYS).select("id", walked.alias("way")).select("id", "way.*")


_INCLINE = "CASE incline WHEN '5%' THEN 5.0 WHEN '-8 %' THEN 8.0 WHEN '10°' THEN 17.6 WHEN 'steep' THEN 12.0 WHEN '12,34' THEN 12.3 END::DOUBLE"
_SURFACE = "CASE surface WHEN 'Sett; x' THEN 'sett' ELSE surface END"


@query("prj_17_attributes", f"""SELECT id, CASE WHEN highway = 'residential' THEN coalesce(own_surface, {_SURFACE}) ELSE {_SURFACE} END AS surface, smoothness,
    CASE wheelchair WHEN 'designated' THEN 'yes' WHEN 'maybe' THEN NULL ELSE wheelchair END AS wheelchair, {_INCLINE} AS incline_pct,
    CASE WHEN highway = 'steps' AND ramp = 'yes' THEN true END AS ramp, lit <> 'no' AS lit FROM ({WAYS})""")
def _(read):
    kind = F.when(F.col("highway") == "residential", "street").otherwise("path")
    return _tagged(read, "orders", WAYS, _WAY_KEYS).select("id", ways.attributes(F.col("tags"), kind).alias("a")).select("id", "a.*")


@query("str_03_incline", f"SELECT id, {_INCLINE} AS pct FROM ({WAYS})")
def _(read):
    from umbra.functions.text import parse_incline

    return stand_in(read, "orders", WAYS).select("id", parse_incline(F.col("incline")).alias("pct"))


@query("str_04_kerb_metres", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size / 100.0 WHEN 1 THEN p_size / 1000.0 WHEN 2 THEN p_size END::DOUBLE AS m FROM part")
def _(read):
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(size, F.lit(" cm"))).when(F.col("p_partkey") % 4 == 1, F.concat(size, F.lit("mm")))
    raw = raw.when(F.col("p_partkey") % 4 == 2, F.concat(size, F.lit(",0 M"))).otherwise(F.concat(F.lit("-"), size))
    return read("part").select(F.col("p_partkey").alias("id"), tags.kerb_metres(raw).alias("m"))


@query("str_02_count", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 0.0 WHEN 2 THEN -p_size END::DOUBLE AS n FROM part")
def _(read):
    from umbra.functions.text import parse_count

    size, rest = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    raw = F.when(rest == 0, F.concat(F.lit(" "), size, F.lit(",5"))).when(rest == 1, F.lit(" ")).when(rest == 2, F.concat(F.lit("-"), size)).otherwise(F.lit("1,2,3"))
    return read("part").select(F.col("p_partkey").alias("id"), parse_count(raw).alias("n"))


SPOTS = _table("part", "p_partkey", {
    "amenity": ["fountain", "drinking_water", "bench", "shelter", "water_point", None, None, None], "made": [None, None, "water_tap", None, "drinking_fountain"], "fountain": [None, "mist", "bubbler", None],
    "drinkable": [None, "yes", "no"], "name": [None, "Kurtyna wodna", "Fontanna", None, None], "leisure": [None, "park", "garden"], "garden": [None, "private", None], "access": [None, None, None, None, "private"],
    "highway": [None, None, "path"],
})
_SPOT_KEYS = {"amenity": "amenity", "man_made": "made", "fountain": "fountain", "drinking_water": "drinkable", "name": "name", "leisure": "leisure", "garden:type": "garden", "access": "access", "highway": "highway"}


@query("prj_20_cool_spots", f"""SELECT id, CASE WHEN access = 'private' THEN NULL WHEN amenity = 'fountain' AND fountain = 'mist' THEN 'water_mist'
    WHEN name = 'Kurtyna wodna' AND (amenity IN ('fountain', 'drinking_water', 'water_point') OR made IS NOT NULL OR (id % 2 = 0 AND highway IS NULL)) THEN 'water_mist'
    WHEN amenity IN ('drinking_water', 'water_point') OR made = 'drinking_fountain' THEN 'drinking_water' WHEN made = 'water_tap' THEN CASE WHEN drinkable = 'no' THEN NULL ELSE 'drinking_water' END
    WHEN amenity = 'fountain' THEN CASE WHEN drinkable = 'yes' OR fountain = 'bubbler' THEN 'drinking_water' ELSE 'fountain' END WHEN amenity IN ('bench', 'shelter') THEN amenity
    WHEN id % 2 = 1 AND leisure IS NOT NULL AND (garden IS NULL OR name IS NOT NULL) THEN 'park' END AS kind FROM ({SPOTS})""")
def _(read):
    return _tagged(read, "part", SPOTS, _SPOT_KEYS).select("id", ways.cool_spot_kind(F.col("tags"), F.col("id") % 2 == 1).alias("kind"))


# --- costs -------------------------------------------------------------------------------------------------------
_FELT = f"SELECT *, CASE id % 3 WHEN 0 THEN 'accessible' WHEN 1 THEN 'senior' ELSE 'default' END AS mobility, {_INCLINE} AS pct, {_SURFACE} AS ground FROM ({WAYS})"
_BASE = "CASE ground WHEN 'sett' THEN 1.6 WHEN 'gravel' THEN 2.2 ELSE 1.0 END::DOUBLE"
_SF = f"CASE WHEN smoothness = 'good' THEN least({_BASE}, 1.2::DOUBLE) ELSE {_BASE} END"


@query("prj_23_mobility", f"""SELECT id, mobility, round(CASE mobility WHEN 'default' THEN 1.0 WHEN 'accessible' THEN CASE WHEN highway = 'steps' OR wheelchair = 'no' OR pct > 10 OR smoothness = 'horrible' THEN NULL
    ELSE CASE WHEN wheelchair = 'limited' THEN 1.5::DOUBLE ELSE 1 END * ({_SF}) * CASE WHEN smoothness = 'bad' THEN 1.8::DOUBLE ELSE 1 END * CASE WHEN pct > 6 THEN 3.0::DOUBLE WHEN pct > 3 THEN 1.4 ELSE 1 END END
    ELSE CASE WHEN highway = 'steps' THEN CASE WHEN ramp = 'yes' THEN 1.5::DOUBLE ELSE 3 END ELSE 1 END * (1 + (({_SF}) - 1) * 0.35::DOUBLE)
    * (1 + (CASE smoothness WHEN 'bad' THEN 1.8::DOUBLE WHEN 'horrible' THEN 5 ELSE 1 END - 1) * 0.35::DOUBLE) * CASE WHEN pct > 10 THEN 1.8::DOUBLE WHEN pct > 6 THEN 1.4 ELSE 1 END END, 9) AS factor FROM ({_FELT})""")
def _(read):
    from umbra.functions.text import clean_value, parse_incline

    mobility = F.when(F.col("id") % 3 == 0, "accessible").when(F.col("id") % 3 == 1, "senior").otherwise("default")
    steps = F.coalesce(F.col("highway") == "steps", F.lit(False))
    factor = costs.way_factor(mobility, steps, clean_value(F.col("surface")), F.col("smoothness"), F.col("wheelchair"), parse_incline(F.col("incline")), F.col("ramp") == "yes")
    return stand_in(read, "orders", WAYS).select("id", mobility.alias("mobility"), F.round(factor, 9).alias("factor"))


EDGES = """SELECT l_orderkey AS way, l_linenumber AS seq, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS length_m, sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey) AS way_m,
    CASE l_orderkey % 3 WHEN 0 THEN 'crossing' WHEN 1 THEN 'steps' ELSE 'footway' END AS kind, l_partkey % 2 = 0 AS signals, CAST(l_discount AS DOUBLE) * 10 AS sun, CAST(l_tax AS DOUBLE) * 10 AS heat FROM lineitem"""
_WAIT = "CASE WHEN kind = 'crossing' THEN CASE WHEN signals THEN 25 ELSE 5 END * least(1.0, length_m / way_m) ELSE 0 END"


@query("prj_24_waits", f"SELECT way, seq, l_partkey, l_suppkey, round({_WAIT}, 6) AS wait_s FROM ({EDGES})")
def _(read):
    wait = costs.wait_s(F.col("kind"), F.col("signals"), F.col("length_m"), F.col("way_m"))
    return stand_in(read, "lineitem", EDGES).select("way", "seq", "l_partkey", "l_suppkey", F.round(wait, 6).alias("wait_s"))


@query("prj_25_times", f"SELECT way, seq, l_partkey, l_suppkey, round(length_m / (1.0 * CASE kind WHEN 'steps' THEN 0.5 ELSE 1 END * CASE kind WHEN 'steps' THEN 0.7 ELSE 1 END)::DOUBLE + {_WAIT}, 6) AS time_s FROM ({EDGES})")
def _(read):
    wait = costs.wait_s(F.col("kind"), F.col("signals"), F.col("length_m"), F.col("way_m"))
    slow = F.when(F.col("kind") == "steps", 0.5).otherwise(1.0)
    time = costs.time_s(F.col("length_m"), F.lit(costs.SPEEDS["senior"]), slow, F.lit("senior"), F.col("kind") == "steps", wait)
    return stand_in(read, "lineitem", EDGES).select("way", "seq", "l_partkey", "l_suppkey", F.round(time, 6).alias("time_s"))


@query("prj_26_edge_cost", f"""SELECT way, seq, l_partkey, l_suppkey, round(length_m * CASE kind WHEN 'steps' THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN way % 5 = 0 THEN NULL ELSE 1.5::DOUBLE END * (1 + 2.25::DOUBLE * sun + 0.25::DOUBLE * heat) + 3, 6) AS cost
    FROM ({EDGES})""")
def _(read):
    weights = costs.profile_weights(F.lit("balanced"), F.lit(0.5), F.lit("shade"))
    penalty, mobility = F.when(F.col("kind") == "steps", 1.2).otherwise(1.0), F.when(F.col("way") % 5 != 0, 1.5)
    cost = costs.edge_cost(F.col("length_m"), penalty, mobility, weights["sun"], F.col("sun"), weights["heat"], F.col("heat"), F.lit(3.0))
    return stand_in(read, "lineitem", EDGES).select("way", "seq", "l_partkey", "l_suppkey", F.round(cost, 6).alias("cost"))


@query("prj_27_profiles", """SELECT id, profile, round(CASE profile WHEN 'balanced' THEN 0.5 + 3.5 * p ELSE 10 END::DOUBLE, 9) AS sun, round(CASE WHEN id % 2 = 0 THEN 0 WHEN profile = 'balanced' THEN 0.5 * p ELSE 1 END::DOUBLE, 9) AS heat,
    CASE profile WHEN 'balanced' THEN 1.35 ELSE 2.0 END::DOUBLE AS most_detour FROM (SELECT c_custkey AS id, greatest(0, least(1, (c_custkey % 15 - 2) / 10.0::DOUBLE)) AS p FROM customer), (VALUES ('balanced'), ('shadiest')) v(profile)""")
def _(read):
    rows = read("customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(F.lit("balanced"), F.lit("shadiest"))).alias("profile"))
    weights = costs.profile_weights(F.col("profile"), (F.col("id") % 15 - 2) / 10.0, F.when(F.col("id") % 2 == 0, "sun").otherwise("shade"))
    return rows.select("id", "profile", weights.alias("w")).select("id", "profile", F.round("w.sun", 9).alias("sun"), F.round("w.heat", 9).alias("heat"), "w.most_detour")


WEATHER = """SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN event_id % 55 - 10.0 END AS air, CASE WHEN event_id % 4 <> 0 THEN event_id % 61 - 12.0 END AS apparent, CAST(event_id % 100 - 20 AS DOUBLE) / 70 AS altitude,
    CASE WHEN event_id % 3 = 0 THEN event_id % 900 - 50.0 END AS dni, CASE WHEN event_id % 2 = 0 THEN event_id % 120 * 1.0 END AS cloud, CAST(event_id % 13 AS DOUBLE) / 10 AS exposure FROM events"""
_DELTA = f"""SELECT id, coalesce(apparent, air) AS shade, CASE WHEN altitude > 0 AND coalesce(air, apparent) IS NOT NULL THEN least(12.0::DOUBLE, greatest(0.0, 0.3::DOUBLE * (pow(pow(t, 4) + 0.7::DOUBLE * 0.308::DOUBLE * cos(radians(g * (1 - g * g / 48402)))
    * beam * 1.3::DOUBLE / (0.97::DOUBLE * 5.670374e-8::DOUBLE), 0.25::DOUBLE) - t))) ELSE 0 END AS delta, least(1.0::DOUBLE, exposure) AS exposure FROM (SELECT *, coalesce(air, apparent)::DOUBLE + 273.15::DOUBLE AS t, least(90.0::DOUBLE, degrees(altitude::DOUBLE)) AS g,
    CASE WHEN dni IS NOT NULL THEN greatest(0, dni) WHEN cloud IS NOT NULL THEN 750 * (1 - 0.9::DOUBLE * pow(least(100, cloud) / 100.0::DOUBLE, 2)) ELSE 750 END::DOUBLE AS beam FROM ({WEATHER}))"""


@query("prj_28_thermal", f"""SELECT id, round(shade + delta, 6) AS sun_c, round(shade + delta * exposure, 6) AS mean_c, CASE WHEN shade IS NULL THEN NULL WHEN m > 46 THEN 'extreme' WHEN m > 38 THEN 'very_strong' WHEN m > 32 THEN 'strong' WHEN m > 26 THEN 'moderate'
    WHEN m < 9 THEN 'cold' ELSE 'none' END AS stress FROM (SELECT *, shade + delta * exposure AS m FROM ({_DELTA}))""")
def _(read):
    rows = stand_in(read, "events", WEATHER)
    rows = rows.select("id", *(F.col(c).cast("double").alias(c) for c in ("air", "apparent", "altitude", "dni", "cloud", "exposure")))
    shade = F.coalesce("apparent", "air")
    delta = costs.sun_delta(F.coalesce("air", "apparent"), F.col("altitude"), F.col("dni"), F.col("cloud"))
    whole = costs.thermal(*(F.col(c) for c in ("air", "apparent", "altitude", "dni", "cloud", "exposure")))
    return rows.select("id", F.round(shade + delta, 6).alias("sun_c"), F.round(shade + delta * F.least(F.lit(1.0), "exposure"), 6).alias("mean_c"), whole["stress"].alias("stress"))


@query("prj_30_comfort", f"""SELECT id, CASE id % 3 WHEN 0 THEN 'shade' WHEN 1 THEN 'sun' ELSE CASE WHEN coalesce(apparent, air) IS NOT NULL THEN CASE WHEN coalesce(apparent, air) < 12 THEN 'sun' ELSE 'shade' END
    WHEN id % 12 + 1 IN (11, 12, 1, 2, 3) THEN 'sun' ELSE 'shade' END END AS comfort FROM ({WEATHER})""")
def _(read):
    mode = F.when(F.col("id") % 3 == 0, "shade").when(F.col("id") % 3 == 1, "sun").otherwise("auto")
    return stand_in(read, "events", WEATHER).select("id", costs.comfort(mode, F.coalesce("apparent", "air"), F.col("id") % 12 + 1).alias("comfort"))


@query("prj_31_height_source", "SELECT p_partkey AS id, CASE WHEN p_partkey % 21 >= 19 THEN 'lidar' WHEN p_partkey % 21 > 0 THEN 'mixed' ELSE 'osm' END AS source FROM part")
def _(read):
    share = F.when(F.col("p_partkey") % 21 > 0, (F.col("p_partkey") % 21) / 20.0)
    return read("part").select(F.col("p_partkey").alias("id"), costs.height_source(share).alias("source"))
