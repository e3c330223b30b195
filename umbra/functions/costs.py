"""What an edge costs a walker and how warm the way feels, as Column expressions; null stands for forbidden."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.geo import clamp, rounded

#: How much harder surfaces and (null: forbidden) lacks of smoothness are on wheels.
SURFACES = {
    "sand": 3.0, "mud": 3.0, "grass": 2.5, "woodchips": 2.5, "cobblestone": 2.5, "unhewn_cobblestone": 2.5, "pebblestone": 2.2, "gravel": 2.2, "unpaved": 2.0,
    "ground": 2.0, "dirt": 2.0, "earth": 2.0, "grass_paver": 1.8, "cobblestone:flattened": 1.8, "sett": 1.6, "fine_gravel": 1.4, "compacted": 1.3, "wood": 1.2, "metal": 1.2,
}
SMOOTHNESS = {"intermediate": 1.15, "bad": 1.8, "very_bad": 3.0}
IMPASSABLE = ("horrible", "very_horrible", "impassable")
#: Seniors feel a share of the surface; waits at crossings (s); walking speeds (m/s) by mobility.
SOFTENED, SIGNAL_S, CROSSING_S = 0.35, 25.0, 5.0
SPEEDS = {"default": 1.3, "accessible": 1.1, "senior": 1.0}
#: Fixed values of the body in the sun.
BOLTZMANN, ABSORBED, EMITTED, GAIN, FELT_SHARE, MOST_DELTA, CLEAR_DNI = 5.670374e-8, 0.7, 0.97, 1.3, 0.3, 12.0, 750.0


def _look_up(table: dict[str, float], key: Column) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    return F.coalesce(found, F.lit(1.0))


def surface_factor(surface: Column, smoothness: Column) -> Column:
    """A way that is smooth for certain is no harder than 1.2, whatever its surface."""
    factor = _look_up(SURFACES, surface)
    return F.when(smoothness.isin("excellent", "good"), F.least(factor, F.lit(1.2))).otherwise(factor)


def way_factor(mobility: Column, steps: Column, surface: Column, smoothness: Column, wheelchair: Column, incline_pct: Column, ramp: Column) -> Column:
    """How much harder a way is for a mobility; null where it is forbidden."""
    by_surface, rough = surface_factor(surface, smoothness), F.coalesce(smoothness.isin(*IMPASSABLE), F.lit(False))
    by_smoothness = _look_up(SMOOTHNESS, smoothness)
    barred = steps | F.coalesce(wheelchair == "no", F.lit(False)) | F.coalesce(incline_pct > 10, F.lit(False)) | rough
    slope = F.when(incline_pct > 6, 3.0).when(incline_pct > 3, 1.4).otherwise(1.0)
    wheels = F.when(~barred, F.when(wheelchair == "limited", 1.5).otherwise(1.0) * by_surface * by_smoothness * slope)
    soft = lambda factor: 1 + (factor - 1) * SOFTENED
    steep = F.when(incline_pct > 10, 1.8).when(incline_pct > 6, 1.4).otherwise(1.0)
    stairs = F.when(steps, F.when(F.coalesce(ramp, F.lit(False)), 1.5).otherwise(3.0)).otherwise(1.0)
    senior = stairs * soft(by_surface) * soft(F.when(rough, 5.0).otherwise(by_smoothness)) * steep
    return F.when(mobility == "accessible", wheels).when(mobility == "senior", senior).otherwise(1.0)


def wait_s(kind: Column, signals: Column, length_m: Column, way_length_m: Column) -> Column:
    """A crossing's wait, shared among its edges by length."""
    share = F.when(way_length_m > 1e-6, F.least(F.lit(1.0), length_m / way_length_m)).otherwise(0.0)
    return F.when(kind == "crossing", F.when(signals, SIGNAL_S).otherwise(CROSSING_S) * share).otherwise(0.0)


def time_s(length_m: Column, walk_speed: Column, speed_factor: Column, mobility: Column, steps: Column, wait: Column) -> Column:
    slow = F.when((mobility == "senior") & steps, 0.7).otherwise(1.0)
    return length_m / (walk_speed * speed_factor * slow) + wait


def edge_cost(length_m: Column, penalty: Column, mobility: Column, sun_weight: Column, discomfort: Column, heat_weight: Column, heat: Column, fixed_m: Column) -> Column:
    """Metres that an edge counts for; null where the mobility's factor is."""
    more = 1 + F.when(sun_weight > 0, sun_weight * discomfort).otherwise(0.0) + F.when(heat_weight > 0, heat_weight * heat).otherwise(0.0)
    return length_m * penalty * mobility * more + fixed_m


def profile_weights(profile: Column, preference: Column, comfort: Column) -> Column:
    """sun, heat and most_detour of the balanced and the extreme profile."""
    wish, balanced, cold = clamp(preference, 0.0, 1.0), profile == "balanced", comfort == "sun"
    return F.struct(
        F.when(balanced, 0.5 + 3.5 * wish).otherwise(10.0).alias("sun"),
        F.when(cold, 0.0).when(balanced, 0.5 * wish).otherwise(1.0).alias("heat"),
        F.when(balanced, 1.35).otherwise(2.0).alias("most_detour"),
    )


def sun_delta(air_c: Column, altitude_rad: Column, dni: Column, cloud_pct: Column) -> Column:
    """Degrees that the sun feels warmer than the shade."""
    cloud = clamp(cloud_pct, 0.0, 100.0) / 100
    beam = F.when(dni.isNotNull(), F.greatest(F.lit(0.0), dni)).when(cloud_pct.isNotNull(), CLEAR_DNI * (1 - 0.9 * cloud * cloud)).otherwise(CLEAR_DNI)
    gamma = F.least(F.lit(90.0), F.degrees(altitude_rad))
    taken = ABSORBED * 0.308 * F.cos(F.radians(gamma * (1 - gamma * gamma / 48402))) * beam * GAIN
    shade = air_c + 273.15
    sun = F.pow(F.pow(shade, F.lit(4.0)) + taken / (EMITTED * BOLTZMANN), F.lit(0.25))
    return F.when((altitude_rad > 0) & air_c.isNotNull(), clamp(FELT_SHARE * (sun - shade), 0.0, MOST_DELTA)).otherwise(0.0)


def stress(felt_c: Column) -> Column:
    word = F.when(felt_c > 46, "extreme").when(felt_c > 38, "very_strong").when(felt_c > 32, "strong").when(felt_c > 26, "moderate")
    return word.when(felt_c < 9, "cold").when(felt_c.isNotNull(), "none")


def thermal(air_c: Column, apparent_c: Column, altitude_rad: Column, dni: Column, cloud_pct: Column, exposure: Column) -> Column:
    """How warm it feels in the sun, in the shade and along the way; all null without a temperature."""
    shade = F.coalesce(apparent_c, air_c)
    delta = sun_delta(F.coalesce(air_c, apparent_c), altitude_rad, dni, cloud_pct)
    mean = shade + delta * F.coalesce(clamp(exposure, 0.0, 1.0), F.lit(0.0))
    return F.struct(rounded(shade + delta, 1).alias("sun_c"), rounded(shade, 1).alias("shade_c"), rounded(mean, 1).alias("mean_c"), stress(mean).alias("stress"))


def comfort(mode: Column, felt_c: Column, month: Column) -> Column:
    """Whether sun or shade is sought: below 12 degrees the sun; without weather from November to March."""
    auto = F.when(felt_c.isNotNull(), F.when(felt_c < 12, "sun").otherwise("shade")).otherwise(F.when(month.isin(11, 12, 1, 2, 3), "sun").otherwise("shade"))
    return F.when(mode == "auto", auto).otherwise(mode)


def height_source(coverage: Column) -> Column:
    known = F.coalesce(coverage, F.lit(0.0))
    return F.when(known >= 0.95, "lidar").when(known > 0, "mixed").otherwise("osm")
