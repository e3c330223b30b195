"""Line deduplication [native]: deletion-neighbourhood join with at most one character edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.shared import stash, within

#: Characters that a line needs for near matching, and characters in a block.
NEAR_CHARS, BLOCK = 20, 32

_TRIMMED = " \t\x0b\x0c\r"


def _half_keys(line: Column, n: Column) -> Column:
    """Two keys as a line of n characters and two as one with a character more than n-1: equal first or last halves.

    Of two lines one edit apart, either what precedes the middle of the shorter one or what follows it is equal.
    """

    def halves(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit(0), m, F.substring(line, F.lit(1), half)), F.xxhash64(F.lit(1), m, F.right(line, m - half))]

    return F.array(*halves(n), *halves(n - 1))


def _blocks(line: Column, n: Column) -> Column:
    """(role, place, key, block): everything but one block of the line hashed, for both roles of a line.

    Role 0 is a line of its own length with blocks of 32 characters; role 1 is one with an extra character in the block.
    """

    def of(role: int) -> Column:
        base = n - role
        return F.transform(
            F.sequence(F.lit(0), F.floor((base - 1) / BLOCK).cast("int")),
            lambda b: F.struct(
                F.lit(role).alias("role"),
                F.xxhash64(base, b, F.substring(line, F.lit(1), b * BLOCK), F.substring(line, b * BLOCK + BLOCK + 1 + role, n)).alias("key"),
                F.substring(line, b * BLOCK + 1, F.lit(BLOCK + role)).alias("block"),
            ),
        )

    return F.concat(of(0), of(1))


def _variants() -> Column:
    """(side, hash) of the block's variants: 2 a deletion among equals in length, 0 a whole block, 1 a deletion from a longer one."""
    places = F.sequence(F.lit(1), F.char_length("block"))
    without = lambda i: (F.substring("block", F.lit(1), i - 1), F.substring(F.col("block"), i + 1, F.char_length("block")))
    as_pair = lambda side, code: F.struct(F.lit(side).alias("side"), code.alias("code"))
    own = F.transform(places, lambda i: as_pair(2, F.xxhash64("key", i, F.concat(*without(i)))))
    whole = F.array(as_pair(0, F.xxhash64("key", F.lit(-1), "block")))
    shorter = F.transform(places, lambda i: as_pair(1, F.xxhash64("key", F.lit(-1), F.concat(*without(i)))))
    return F.when(F.col("role") == 0, F.concat(own, whole)).otherwise(shorter)


def _shared(rows: DataFrame) -> DataFrame:
    """Keys that at least two different lines have."""
    ends = rows.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most"))
    return ends.where("least <> most").select("key")


def _near_lines(source: DataFrame, lite: DataFrame, near_chars: int) -> DataFrame:
    """h1 of the lines that an earlier line is within one edit of."""
    halves = lite.where(F.col("halves").isNotNull()).select("h1", F.explode("halves").alias("key"))
    some = halves.join(_shared(halves), "key", "left_semi").select("h1").distinct()
    some = within(stash(some, "lines-some"))
    texts = source.select("dkey", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    texts = texts.select("dkey", "at", F.btrim("raw", F.lit(_TRIMMED)).alias("line")).where(F.char_length("line") >= near_chars)
    texts = texts.withColumn("h1", F.xxhash64("line")).join(some, "h1", "left_semi")
    distinct = stash(texts.groupBy("h1").agg(F.min(F.struct("dkey", "at")).alias("pos"), F.first("line").alias("line")), "lines-near")

    blocks = distinct.select("h1", "pos", F.explode(_blocks(F.col("line"), F.char_length("line"))).alias("b")).select("h1", "pos", "b.*")
    blocks = blocks.join(_shared(blocks), "key", "left_semi")
    variants = blocks.select("h1", "pos", F.explode(_variants()).alias("v")).select("h1", "pos", "v.side", "v.code")
    earliest = variants.groupBy("code", "side").agg(F.min(F.struct("pos", "h1")).alias("e")).select("code", F.col("side").alias("of"), "e.*")
    earliest = earliest.select("code", "of", F.col("pos").alias("before"), F.col("h1").alias("partner"))
    pairs = variants.join(earliest, "code").where("before < pos AND ((side = 2 AND of = 2) OR side + of = 1)")
    pairs = pairs.select("h1", "partner").distinct()
    left, right = distinct.select("h1", "line"), distinct.select(F.col("h1").alias("partner"), F.col("line").alias("other"))
    checked = pairs.join(left, "h1").join(right, "partner").where(F.levenshtein("line", "other", 1) == 1)
    return checked.select("h1").distinct()


def line_dedup(
    docs: DataFrame, near_chars: int = NEAR_CHARS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_removed and the columns in ``keep``; one row per input row.

    Lines are split at \\n and compared without white space at their ends. Of equal lines the earliest (by id, then by
    place) stays; a line of at least ``near_chars`` characters also goes if an earlier one is within one inserted, deleted
    or replaced character, whether or not that one stays. Blank lines are never removed.

    Near matches come from the deletion neighbourhood. Two exact filters keep it small: lines must share a half, then
    all but a block of 32 characters, with another line; only in such blocks are the deletion variants emitted,
    as hashes of the rest of the line and of the block without a character. Lines that meet under a variant of
    equal length differ at one place, so each needs only its group's earliest line, not every pair; every
    match is then checked by edit distance. Equal lines are grouped by 128 bits of hashes.

    Null text stays null and has no lines. Null ids sort first. Rows repeated with the same id and text count
    as one document and keep the same lines. Long lines cost time in proportion to their blocks. An empty
    table gives an empty result.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("dkey"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("version"),
        *(F.col(k).alias(f"kept_{i}") for i, k in enumerate(keep or [])),
    )
    passed = [F.col(f"kept_{i}").alias(k) for i, k in enumerate(keep or [])]
    line = F.btrim("raw", F.lit(_TRIMMED))
    rows = source.select("dkey", "version", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("line", line).where("line <> ''")
    n = F.char_length("line")
    lite = rows.select(
        "dkey",
        "version",
        "at",
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
        F.when(n >= near_chars, _half_keys(F.col("line"), n)).alias("halves"),
    )
    lite = stash(lite, "lines")
    near = _near_lines(source, lite, near_chars).withColumn("near", F.lit(True))
    firsts = lite.groupBy("h1", "h2").agg(F.min(F.struct("dkey", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    told = firsts.join(near, "h1", "left").where("n > 1 OR near").select("h1", "h2", "first", "near")
    gone = lite.drop("halves").join(told, ["h1", "h2"]).where("near OR first <> struct(dkey, at)")
    gone = gone.groupBy("dkey", "version").agg(F.collect_set("at").alias("gone")).hint("shuffle_hash")
    joined = source.join(gone, ["dkey", "version"], "left")
    # a generator keeps the split lines from being computed anew for every line
    lined = joined.select("doc_id", "text", "gone", *(c for c in joined.columns if c.startswith("kept_")), F.explode(F.array(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    return lined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        *passed,
    )
