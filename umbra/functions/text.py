"""Parsing and rendering of tag values, labels and instructions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.geo import clamp, rounded

_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def parse_metres(raw: Column) -> Column:
    """Metres from text with a decimal comma or point and a unit (none, m, metres, ft, feet, ')."""
    text = F.lower(F.trim(F.replace(raw, F.lit(","), F.lit("."))))
    value = _number(text, rf"^{_NUMBER}\s*(?:m|metres|meters|ft|feet|')?$")
    return F.when(text.rlike(r"(ft|feet|')$"), value * 0.3048).otherwise(value)


def parse_incline(raw: Column) -> Column:
    """Percent without its sign: n or n%, n degrees under 90, steep 12, flat or level 0; at most 100, one decimal; others null."""
    text = F.lower(F.trim(F.replace(raw, F.lit(","), F.lit("."))))
    size = F.abs(_number(text, r"^([+-]?[0-9]+(?:\.[0-9]+)?)\s*(?:%|°|deg)?$"))
    slope = F.when(size < 90, F.tan(F.radians(size)) * 100)
    percent = F.when(text == "steep", F.lit(12.0)).when(text.isin("flat", "level"), F.lit(0.0))
    percent = percent.when(text.endswith("°") | text.endswith("deg"), slope).otherwise(size)
    return rounded(clamp(percent, 0.0, 100.0), 1)


def parse_count(raw: Column) -> Column:
    """A number with a decimal comma or point; empty text counts as 0, anything else is null."""
    text = F.replace(F.trim(raw), F.lit(","), F.lit("."))
    return F.when(text == "", F.lit(0.0)).otherwise(_number(text, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"))


def clean_value(raw: Column) -> Column:
    """First of values split by semicolons, lower case, trimmed, at most 40 characters; empty is null."""
    return F.nullif(F.substring(F.lower(F.trim(F.split_part(raw, F.lit(";"), F.lit(1)))), 1, 40), F.lit(""))


def clip(text: Column, most: int) -> Column:
    """Text cut to ``most`` characters, the last of them an ellipsis where something was cut."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


#: Every character that counts as white space besides control characters (fixed values).
WHITE = r" \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def sanitise(raw: Column) -> Column:
    """Control characters become spaces, white space is collapsed and trimmed, 120 characters at most."""
    return clip(F.trim(F.regexp_replace(F.regexp_replace(raw, r"[\x00-\x1F\x7F]", " "), f"[{WHITE}]+", " ")), 120)


def distance_text(metres: Column) -> Column:
    """From 995 m kilometres with one decimal and a comma, below 15 m exact but 1 at least, else to the nearest ten."""
    km = F.format_string("%.1f km", rounded(metres / 1000, 1))
    ten = F.when(metres < 15, F.when(metres.isNotNull(), F.greatest(F.lit(1.0), rounded(metres)))).otherwise(rounded(metres / 10) * 10)
    return F.when(metres >= 995, F.replace(km, F.lit("."), F.lit(","))).otherwise(F.concat(ten.cast("long").cast("string"), F.lit(" m")))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Polish plural of the rounded number, whatever its sign: 1; 2 to 4 but not 12 to 14; all others."""
    n = F.abs(rounded(n)).cast("long")
    return F.when(n == 1, one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)


def asset_urls(html: Column) -> Column:
    """Distinct src and href values under /assets/ in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?:src|href)="(/assets/[^"]+)"'), F.lit(1)))


#: Words that tell by themselves what a name is.
TELLING = (
    r"ul\.|ulica|al\.|aleja|aleje|plac|pl\.|rynek|mały rynek|rondo|most|bulwar|bulwary|osiedle|os\.|planty|park|skwer|droga|pasaż|kładka|"
    r"estakada|trakt|ścieżka|wybrzeże|zaułek|dziedziniec|ogród|błonia|tunel|przejście"
)


def street_label(name: Column) -> Column:
    """The name, with "ul. " before it unless it tells what it is."""
    return F.when(name.rlike(rf"(?iu)^({TELLING})(\s|$)"), name).otherwise(F.concat(F.lit("ul. "), name))


def shade_phrase(sun_share: Column) -> Column:
    return F.when(sun_share < 0.25, " — w cieniu").when(sun_share <= 0.6, " — częściowo w cieniu").when(sun_share.isNotNull(), " — w słońcu")


def _one_decimal(x: Column) -> Column:
    return F.replace(F.format_string("%.1f", rounded(x, 1)), F.lit("."), F.lit(","))


def _whole(x: Column) -> Column:
    return rounded(x).cast("long").cast("string")


def short_distance(metres: Column) -> Column:
    """Below 100 m exact, below 1 km to the nearest ten, then kilometres with one decimal."""
    near = F.when(metres < 100, rounded(metres)).otherwise(rounded(metres / 10) * 10)
    return F.when(near < 1000, F.concat(_whole(near), F.lit(" m"))).otherwise(F.concat(_one_decimal(metres / 1000), F.lit(" km")))


def duration_text(seconds: Column) -> Column:
    """Minutes, 1 at least; from an hour on hours and the minutes left, if any."""
    minutes = F.when(seconds.isNotNull(), F.greatest(F.lit(1), rounded(seconds / 60).cast("long")))
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    long = F.when(minutes % 60 == 0, F.concat(hours, F.lit(" h"))).otherwise(F.concat(hours, F.lit(" h "), rest, F.lit(" min")))
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(long)


def percent_text(share: Column) -> Column:
    return F.concat(_whole(clamp(share, 0.0, 1.0) * 100), F.lit("%"))


def temperature_text(celsius: Column) -> Column:
    return F.concat(_whole(celsius), F.lit("°C"))


def spoken_distance(metres: Column) -> Column:
    """Below 100 m to the nearest ten (10 at least), below 950 m to the nearest fifty, then kilometres without a zero decimal."""
    fine = F.greatest(F.lit(10.0), rounded(metres / 10) * 10)
    near = F.when(metres < 100, fine).otherwise(rounded(metres / 50) * 50)
    far = F.regexp_replace(_one_decimal(rounded(metres / 100) / 10), ",0$", "")
    return F.when(metres >= 950, F.concat(far, F.lit(" kilometra"))).when(metres.isNotNull(), F.concat(_whole(near), F.lit(" metrów")))


def split_instruction(raw: Column) -> tuple[Column, Column]:
    """What comes before a sentence that begins with "Idź", and that sentence with the rest."""
    text = F.trim(raw)
    pattern = r"(?s)^(.*?[.!])\s+(Idź\s.*)$"
    lead, rest = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(rest == "", text).otherwise(lead), rest


#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("ul", "al", "pl", "os", "np", "św", "ok", "godz", "tzw", "tj", "im", "ks", "dr", "prof", "gen", "min", "in")
_BEFORE = r"(?:^|[^\p{L}\d])"
# The full stop comes first: what lies before it is looked at only there.
_HELD = rf"\.(?=\s)(?:(?<={_BEFORE}(?:(?iu:{'|'.join(ABBREVIATIONS)})|\p{{L}})\.)|(?<={_BEFORE}\d{{1,18}}\.)(?=\s++(?!\p{{Lu}})))\s+"


def sentences(text: Column) -> Column:
    """Sentences with white space collapsed: they end with . ! ? … and closing marks before white space, or with a line.

    No end is a full stop after an abbreviation, an initial, or a number that no capital follows. What has neither a
    letter nor a digit is left out; null gives null. Markup stays as it is.
    """
    held = F.regexp_replace(text, _HELD, ".\u0002")
    cut = F.regexp_replace(held, r"[.!?…]+[\"”’)\]]*\s+|\n+", "$0\u0001")
    parts = F.transform(F.split(cut, "\u0001"), lambda s: F.trim(F.regexp_replace(s, r"[\s\x02]+", " ")))
    return F.filter(parts, lambda s: s.rlike(r"[\p{L}\d]"))
