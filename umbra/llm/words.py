"""Column expressions for white space, words and normalised text (the ASCII white space \\x20 and \\x09-\\x0D)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches only where collapsing changes something, so single spaces cost one failed probe each.
COLLAPSIBLE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), COLLAPSIBLE, " ")


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters: single spaces of the trimmed, normalised text plus one."""
    flat = F.trim(normalised(text))
    gaps = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(gaps + 1).cast("long")
