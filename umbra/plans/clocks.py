"""Queries of clocks, the sun and texts, with oracles that know the zone's rule (last Sundays of March and October, before 1996 of September, 1 o'clock UTC)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import geo, text, times
from umbra.plans.registry import query

#: Instants through the years from orders, as seconds from 1970; and local clock readings, among them the hours that change.
INSTANTS = "SELECT o_orderkey AS id, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT * 86400 + o_orderkey * 2477 % 86400 AS s FROM orders"
_LAST = "CASE WHEN y < 1996 THEN make_date(y, 9, 30) ELSE make_date(y, 10, 31) END"
_SPRING, _AUTUMN = (f"({day} - dayofweek({day})::INTEGER)" for day in ("make_date(y, 3, 31)", _LAST))
_EDGES = tuple(f"(({day} - DATE '1970-01-01')::BIGINT * 86400 + 3600)" for day in (_SPRING, _AUTUMN))
_OFFSET = f"CASE WHEN s >= {_EDGES[0]} AND s < {_EDGES[1]} THEN 120 ELSE 60 END"
_LOCAL = f"SELECT id, s, m, s + m * 60 AS w, DATE '1970-01-01' + floor((s + m * 60) / 86400)::INTEGER AS d FROM (SELECT *, ({_OFFSET})::INTEGER AS m FROM (SELECT *, year(DATE '1970-01-01' + floor(s / 86400)::INTEGER) AS y FROM ({INSTANTS})))"


def instants(read) -> DataFrame:
    seconds = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400 + F.col("o_orderkey") * 2477 % 86400
    return read("orders").select(F.col("o_orderkey").alias("id"), F.timestamp_seconds(seconds).alias("ts"))


@query("dtm_01_offset_year", f"SELECT id, m AS minutes FROM ({_LOCAL})")
def _(read):
    return instants(read).select("id", times.offset_minutes(F.col("ts")).alias("minutes"))


@query("dtm_04_wall_time", f"SELECT id, d AS day, (floor(w % 86400 / 900) * 15)::INTEGER AS slot, printf('%02d:%02d', (w % 86400 / 3600)::INTEGER, (w % 3600 / 60)::INTEGER) AS clock FROM (SELECT id, d, w - w % 60 AS w FROM (SELECT id, d, w FROM ({_LOCAL})))".replace("(w % 86400 / 3600)::INTEGER", "(w % 86400 // 3600)::INTEGER").replace("(w % 3600 / 60)::INTEGER", "(w % 3600 // 60)::INTEGER"))
def _(read):
    ts = F.col("ts")
    return instants(read).select("id", times.local_date(ts).alias("day"), times.local_minutes(ts, 15).alias("slot"), times.clock_text(times.local_minutes(ts)).alias("clock"))


@query("dtm_05_iso", f"SELECT id, printf('%sT%02d:%02d:%02d+%02d:00', d::VARCHAR, (w % 86400 // 3600)::INTEGER, (w % 3600 // 60)::INTEGER, (w % 60)::INTEGER, m // 60) AS iso FROM ({_LOCAL})")
def _(read):
    return instants(read).select("id", times.iso_local(F.col("ts")).alias("iso"))


# Clock readings: an instant's own date and time, every seventh moved into the hours of a change of that year.
_READINGS = f"""SELECT id, y, CASE id % 7 WHEN 0 THEN {_SPRING} WHEN 1 THEN {_AUTUMN} ELSE d END AS d, CASE WHEN id % 7 < 2 THEN 90 + id * 13 % 120 ELSE (w % 86400 // 60) END::INTEGER AS minutes
    FROM (SELECT *, year(d) AS y FROM ({_LOCAL}))"""
_WALL = f"SELECT *, (d - DATE '1970-01-01')::BIGINT * 86400 + minutes * 60 AS wall FROM ({_READINGS})"


def readings(read) -> DataFrame:
    day = times.local_date(F.col("ts"))
    autumn = F.when(F.year(day) < 1996, F.make_date(F.year(day), F.lit(9), F.lit(30))).otherwise(F.make_date(F.year(day), F.lit(10), F.lit(31)))
    last = F.when(F.col("id") % 7 == 0, F.make_date(F.year(day), F.lit(3), F.lit(31))).otherwise(autumn)
    change = F.date_sub(last, F.dayofweek(last) - 1)
    moved = F.col("id") % 7 < 2
    minutes = F.when(moved, 90 + F.col("id") * 13 % 120).otherwise(times.local_minutes(F.col("ts"))).cast("int")
    return instants(read).select("id", F.when(moved, change).otherwise(day).alias("d"), minutes.alias("minutes"))


# Summer begins at local 2:00, which is 3:00; it ends at local 3:00, and the hour before comes twice.
_SUMMER = f"wall >= {_EDGES[0]} + {{0}} AND wall < {_EDGES[1]} + {{1}}"


@query("dtm_02_instant", f"SELECT id, wall - CASE WHEN {_SUMMER.format(7200, 7200)} THEN 7200 ELSE 3600 END AS s FROM ({_WALL})")
def _(read):
    return readings(read).select("id", F.unix_seconds(times.instant_of(F.col("d"), F.col("minutes"))).alias("s"))


@query("dtm_03_late_instant", f"SELECT id, wall - CASE WHEN {_SUMMER.format(7200, 3600)} THEN 7200 ELSE 3600 END AS s FROM ({_WALL})")
def _(read):
    return readings(read).select("id", F.unix_seconds(times.late_instant_of(F.col("d"), F.col("minutes"))).alias("s"))


@query("dtm_06_valid_dates", "SELECT p_partkey AS id, p_partkey % 13 BETWEEN 1 AND 12 AND p_size BETWEEN 1 AND CASE WHEN p_partkey % 13 = 2 THEN 28 WHEN p_partkey % 13 IN (4, 6, 9, 11) THEN 30 ELSE 31 END AS valid FROM part")
def _(read):
    raw = F.format_string("2023-%02d-%02d", F.col("p_partkey") % 13, F.col("p_size"))
    return read("part").select(F.col("p_partkey").alias("id"), times.is_date(raw).alias("valid"))


@query("dtm_04_parse_clock", "SELECT p_partkey AS id, CASE WHEN p_partkey % 30 <= 23 AND p_size + 20 <= 59 THEN p_partkey % 30 * 60 + p_size + 20 END::INTEGER AS minutes FROM part")
def _(read):
    raw = F.concat((F.col("p_partkey") % 30).cast("string"), F.lit(":"), (F.col("p_size") + 20).cast("string"))
    return read("part").select(F.col("p_partkey").alias("id"), times.parse_clock(raw).alias("minutes"))


@query("dtm_07_day_number", f"SELECT id, round(s / 86400.0::DOUBLE - 0.5 + 2440588 - 2451545, 6) AS days FROM ({INSTANTS})")
def _(read):
    return instants(read).select("id", F.round(times.days_since_2000(F.col("ts")), 6).alias("days"))


@query("dtm_11_buckets", f"SELECT id, floor(s / 600)::BIGINT AS routing, floor(s / 300)::BIGINT AS shadow, DATE '1970-01-01' + floor((s + 1800) / 86400)::INTEGER AS archive_day FROM ({INSTANTS})")
def _(read):
    day = F.date_from_unix_date(F.floor((F.unix_seconds("ts") + 1800) / 86400).cast("int"))
    return instants(read).select("id", times.bucket(F.col("ts"), 10).alias("routing"), times.bucket(F.col("ts"), 5).alias("shadow"), day.alias("archive_day"))


def _sun(days: str) -> str:
    """Right ascension's parts for a day number, as nested selects: anomaly a, ecliptic longitude e, declination c."""
    return f"""SELECT *, asin(sin(radians(23.4397::DOUBLE)) * sin(e)) AS c FROM (SELECT *, a + radians(1.9148::DOUBLE * sin(a) + 0.02::DOUBLE * sin(2 * a) + 0.0003::DOUBLE * sin(3 * a)) + radians(102.9372::DOUBLE) + pi() AS e
        FROM (SELECT *, radians(357.5291::DOUBLE + 0.98560028::DOUBLE * n) AS a FROM ({days})))"""


_PHI = f"radians({geo.CENTRE_LAT}::DOUBLE)"
_POSITION = f"""SELECT *, asin(sin({_PHI}) * sin(c) + cos({_PHI}) * cos(c) * cos(h)) AS altitude, atan2(sin(h), cos(h) * sin({_PHI}) - tan(c) * cos({_PHI})) + pi() AS azimuth FROM (SELECT *, radians(280.16::DOUBLE + 360.9856235::DOUBLE * n)
    + radians({geo.CENTRE_LON}::DOUBLE) - atan2(sin(e) * cos(radians(23.4397::DOUBLE)), cos(e)) AS h FROM ({_sun(f"SELECT *, s / 86400.0::DOUBLE - 0.5 + 2440588 - 2451545 AS n FROM ({_LOCAL})")}))"""


@query("dtm_08_sun_year", f"SELECT id, round(degrees(azimuth), 5) AS azimuth, round(degrees(altitude), 5) AS altitude, altitude > 0 AS is_day FROM ({_POSITION})")
def _(read):
    info = instants(read).select("id", times.sun_info(F.col("ts")).alias("i"))
    return info.select("id", F.round("i.azimuth_deg", 5).alias("azimuth"), F.round("i.altitude_deg", 5).alias("altitude"), F.col("i.is_day").alias("is_day"))


_TRANSIT = f"SELECT *, 0.0009::DOUBLE + west + floor((d - DATE '1970-01-01') + 0.5 - 0.5 + 2440588 - 2451545 - 0.0009::DOUBLE - west + 0.5) AS n FROM (SELECT *, -{geo.CENTRE_LON}::DOUBLE / 360 AS west FROM ({_LOCAL}))"
_RISES = f"""SELECT *, acos((sin(radians(-0.833::DOUBLE)) - sin({_PHI}) * sin(c)) / (cos({_PHI}) * cos(c))) / (2 * pi()) AS half, n + 0.0053::DOUBLE * sin(a) - 0.0069::DOUBLE * sin(2 * e) AS noon FROM ({_sun(_TRANSIT)})"""


@query("dtm_09_sun_times", f"SELECT id, round((noon - half + 0.5 - 2440588 + 2451545) * 86400, 2) AS sunrise_s, round((noon + half + 0.5 - 2440588 + 2451545) * 86400, 2) AS sunset_s FROM ({_RISES})")
def _(read):
    rise, set_ = times.sun_times(F.col("ts"))
    return instants(read).select("id", F.round(rise, 2).alias("sunrise_s"), F.round(set_, 2).alias("sunset_s"))


@query("dtm_10_sun_info", f"SELECT id, round(degrees(altitude), 5) AS altitude, altitude > 0 AS is_day, round(half * 24, 4) AS half_hours FROM ({_POSITION}) JOIN (SELECT id, half FROM ({_RISES})) USING (id)")
def _(read):
    info = instants(read).select("id", times.sun_info(F.col("ts")).alias("i"))
    hours = (F.col("i.sunset_s") - F.col("i.sunrise_s")) / 7200
    return info.select("id", F.round("i.altitude_deg", 5).alias("altitude"), F.col("i.is_day").alias("is_day"), F.round(hours, 4).alias("half_hours"))


@query("dtm_12_arc", "SELECT id, round(CASE WHEN m <= 300 OR m >= 1200 THEN 0 ELSE sin(pi() * (m - 300) / 900) END, 9) AS height FROM (SELECT o_orderkey AS id, o_orderkey * 7 % 1440 AS m FROM orders)")
def _(read):
    height = times.arc_height(F.col("o_orderkey") * 7 % 1440, F.lit(300), F.lit(1200))
    return read("orders").select(F.col("o_orderkey").alias("id"), F.round(height, 9).alias("height"))


# --- texts -------------------------------------------------------------------------------------------------------
_R = "floor({} + 0.5)"


@query("str_08_street_label", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Rynek ' || c_custkey WHEN 1 THEN 'ul. ' || c_custkey WHEN 2 THEN 'ul. Rynkowa' ELSE 'Święty park' END AS label FROM customer".replace("'Święty park'", "'ul. Święty park'"))
def _(read):
    key, rest = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    name = F.when(rest == 0, F.concat(F.lit("Rynek "), key)).when(rest == 1, key).when(rest == 2, "Rynkowa").otherwise("Święty park")
    return read("customer").select(F.col("c_custkey").alias("id"), text.street_label(name).alias("label"))


@query("str_10_client_texts", f"""SELECT id, CASE WHEN d < 995 THEN (CASE WHEN d < 100 THEN {_R.format('d')} ELSE {_R.format('d / 10')} * 10 END)::BIGINT || ' m' ELSE replace(printf('%.1f', {_R.format('d / 100')} / 10), '.', ',') || ' km' END AS distance,
    CASE WHEN mins < 60 THEN mins || ' min' WHEN mins % 60 = 0 THEN (mins // 60) || ' h' ELSE (mins // 60) || ' h ' || (mins % 60) || ' min' END AS duration, {_R.format('least(1.0, d / 2000) * 100')}::BIGINT || '%' AS percent, (id % 60 - 20) || '°C' AS temperature
    FROM (SELECT o_orderkey AS id, (o_orderkey * 3 % 4000)::DOUBLE AS d, greatest(1, {_R.format('(o_orderkey * 11 % 20000) / 60.0')})::BIGINT AS mins FROM orders)""")
def _(read):
    key = F.col("o_orderkey")
    d = (key * 3 % 4000).cast("double")
    return read("orders").select(
        key.alias("id"), text.short_distance(d).alias("distance"), text.duration_text(key * 11 % 20000).alias("duration"), text.percent_text(d / 2000).alias("percent"),
        text.temperature_text(key % 60 - 20).alias("temperature"),
    )


@query("str_15_spoken", f"""SELECT id, CASE WHEN d >= 950 THEN replace(replace(printf('%.1f', {_R.format('d / 100')} / 10), '.', ','), ',0', '') || ' kilometra' WHEN d < 100 THEN greatest(10, {_R.format('d / 10')} * 10)::BIGINT || ' metrów'
    ELSE ({_R.format('d / 50')} * 50)::BIGINT || ' metrów' END AS spoken FROM (SELECT o_orderkey AS id, (o_orderkey * 3 % 4000)::DOUBLE AS d FROM orders)""")
def _(read):
    return read("orders").select(F.col("o_orderkey").alias("id"), text.spoken_distance((F.col("o_orderkey") * 3 % 4000).cast("double")).alias("spoken"))


@query("str_13_compass", "SELECT event_id AS id, (floor(event_id % 720 / 45.0 + 0.5) % 8)::BIGINT AS point FROM events")
def _(read):
    return read("events").select(F.col("event_id").alias("id"), geo.compass(F.col("event_id") % 720).alias("point"))


@query("str_14_split", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Skręć ' || p_size || '.' ELSE 'Prosto ' || p_size END AS lead, CASE WHEN p_partkey % 2 = 0 THEN 'Idź dalej. Idź potem.' ELSE '' END AS rest FROM part")
def _(read):
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" Skręć "), size, F.lit(".  Idź dalej. Idź potem. "))).otherwise(F.concat(F.lit("Prosto "), size))
    lead, rest = text.split_instruction(raw)
    return read("part").select(F.col("p_partkey").alias("id"), lead.alias("lead"), rest.alias("rest"))


@query("str_23_shade_phrase", "SELECT p_partkey AS id, CASE WHEN p_partkey % 101 < 25 THEN ' — w cieniu' WHEN p_partkey % 101 <= 60 THEN ' — częściowo w cieniu' ELSE ' — w słońcu' END AS phrase FROM part")
def _(read):
    return read("part").select(F.col("p_partkey").alias("id"), text.shade_phrase(F.col("p_partkey") % 101 / 100.0).alias("phrase"))


@query("str_06_sanitise", r"SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 119) || '…' ELSE t END AS label FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(CASE doc_id % 3 WHEN 0 THEN replace(text, ' ', chr(160) || chr(12288)) ELSE text END, '[\x00-\x1F\x7F]', ' ', 'g'), '[ \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS t FROM documents)")
def _(read):
    spread = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("\u00a0\u3000"))).otherwise(F.col("text"))
    return read("documents").select("doc_id", text.sanitise(spread).alias("label"))


@query("mth_01_rounding", "SELECT id, floor(x * 10 + 0.5) / 10 AS tenth, floor(x + 0.5) AS whole, greatest(-1.0, least(2.0, x)) AS within FROM (SELECT event_id AS id, CASE WHEN event_id % 17 > 0 THEN (event_id % 97 - 48) / 8.0::DOUBLE END AS x FROM events)".replace("greatest(-1.0, least(2.0, x))", "CASE WHEN x IS NOT NULL THEN greatest(-1.0, least(2.0, x)) END::DOUBLE"))
def _(read):
    x = F.when(F.col("event_id") % 17 > 0, (F.col("event_id") % 97 - 48) / 8.0)
    return read("events").select(F.col("event_id").alias("id"), geo.rounded(x, 1).alias("tenth"), geo.rounded(x).alias("whole"), geo.clamp(x, -1.0, 2.0).alias("within"))
