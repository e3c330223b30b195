"""Rules over a map of tags as Column expressions; a missing key is a null value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of tags: who may walk, which crossings have lights, what covers a way, which taxa keep their leaves.
FOOT_ALLOWED = ("yes", "designated", "permissive", "official")
FOOT_FORBIDDEN = ("no", "private", "use_sidepath", "discouraged")
ACCESS_FORBIDDEN = ("no", "private")
SIGNAL_CROSSINGS = ("traffic_signals", "pelican", "toucan", "puffin", "pegasus")
TAXON_KEYS = ("genus", "species", "taxon", "genus:la", "species:la", "genus:pl", "species:pl", "taxon:pl")
EVERGREEN = (
    "picea|pinus|abies|thuja|taxus|juniperus|pseudotsuga|tsuga|chamaecyparis|cupressus|cedrus|platycladus|sequoiadendron|ilex|buxus|"
    "świerk|sosna|jodła|żywotnik|tuja|cis|jałowiec|daglezja|cyprysik|cedr"
)
SHEDDING = "larix|metasequoia|taxodium|pseudolarix|modrzew|metasekwoja|cypryśnik"
RAISED_FROM_M = 0.03


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def _is(tags: Column, key: str, *values: str) -> Column:
    return F.coalesce(tag(tags, key).isin(*values), F.lit(False))


def _set(tags: Column, key: str) -> Column:
    """Present and not "no"."""
    return F.coalesce(tag(tags, key) != "no", F.lit(False))


def is_building(tags: Column) -> Column:
    value = F.coalesce(tag(tags, "building"), tag(tags, "building:part"))
    return F.coalesce(value != "no", F.lit(False)) & ~_is(tags, "location", "underground")


def is_canopy(tags: Column) -> Column:
    return _is(tags, "natural", "wood") | _is(tags, "landuse", "forest")


def is_covered(tags: Column) -> Column:
    return _is(tags, "tunnel", "yes", "building_passage") | _is(tags, "covered", "yes", "arcade", "colonnade") | _is(tags, "indoor", "yes")


def may_walk(tags: Column) -> Column:
    """A way with a class, unless foot forbids it, or access does and foot does not allow it."""
    barred = _is(tags, "foot", *FOOT_FORBIDDEN) | (~_is(tags, "foot", *FOOT_ALLOWED) & _is(tags, "access", *ACCESS_FORBIDDEN))
    return F.coalesce(tag(tags, "highway") != "", F.lit(False)) & ~barred


def is_blocked(tags: Column) -> Column:
    """A barrier that nobody passes: foot decides, then access, then whether it is locked."""
    by_access = F.when(tag(tags, "access").isNotNull(), _is(tags, "access", *ACCESS_FORBIDDEN)).otherwise(_is(tags, "locked", "yes"))
    return F.when(~_set(tags, "barrier") | _is(tags, "foot", *FOOT_ALLOWED), False).when(_is(tags, "foot", "no", "private"), True).otherwise(by_access)


def has_signals(tags: Column) -> Column:
    """Lights at a crossing node; what crossing:signals says comes first, then the kinds in crossing, then the road's own lights."""
    kinds = F.transform(F.split(F.coalesce(tag(tags, "crossing"), F.lit("")), ";"), lambda v: F.lower(F.trim(v)))
    by_road = _is(tags, "highway", "traffic_signals") & ~_is(tags, "crossing", "no")
    said = F.when(_is(tags, "crossing:signals", "yes"), True).when(_is(tags, "crossing:signals", "no"), False)
    return said.when(F.arrays_overlap(kinds, F.array(*map(F.lit, SIGNAL_CROSSINGS))), True).otherwise(by_road)


def kerb_metres(raw: Column) -> Column:
    """Height with a decimal comma or point in m (also without a unit), cm or mm; others null."""
    text = F.replace(F.lower(F.trim(raw)), F.lit(","), F.lit("."))
    value = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s*(m|cm|mm)?$", 1).try_cast("double")
    return F.when(text.endswith("cm"), value / 100).when(text.endswith("mm"), value / 1000).otherwise(value)


def is_raised(tags: Column) -> Column:
    """A kerb higher than 3 cm; without a height the kerb's kind decides."""
    return F.coalesce(kerb_metres(tag(tags, "kerb:height")) > RAISED_FROM_M, _is(tags, "kerb", "raised"))


def is_bridge(tags: Column) -> Column:
    return _set(tags, "bridge")


def keeps_leaves(tags: Column) -> Column:
    """By leaf cycle; else conifers that shed do not, other needles do, and the rest by taxon."""
    taxon = F.concat_ws(" ", *(F.coalesce(tag(tags, k), F.lit("")) for k in TAXON_KEYS))
    named = lambda names: taxon.rlike(rf"(?iu)(^|[^\p{{L}}])({names})([^\p{{L}}]|$)")
    by_cycle = F.when(_is(tags, "leaf_cycle", "deciduous", "semi_deciduous"), False).when(_is(tags, "leaf_cycle", "evergreen", "semi_evergreen"), True)
    return by_cycle.when(named(SHEDDING), False).otherwise(_is(tags, "leaf_type", "needleleaved") | named(EVERGREEN))
