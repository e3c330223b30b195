"""Mixing sources to target weights [native]: Sainte-Lague apportionment of equal-word blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.llm.words import word_count
from umbra.shared import stash

#: Words in a block at most, blocks that the smallest target has at least, and documents that a shard holds on average at most.
BLOCK_WORDS, LEAST_BLOCKS, SHARD_DOCS = 128, 16, 4096


def _draw(*parts: Column) -> Column:
    """A repeatable number of 32 bits from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """source, source_size, n_docs, target: ``share`` of all sizes by weight, no target above ``most`` times its size.

    Resharing an excess by weight until none is above ends where every open source gets the same multiple of its
    weight; sorted by size over weight, the capped sources come first, so one pass of running sums finds it.
    Sources are a dimension (a row each), so these windows need no partition.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    everything = W.partitionBy()
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("rank", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick).withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
    fill = W.orderBy(F.col("ceiling") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("ceiling").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / open_weight
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("ceiling") <= F.col("level") * F.col("weight"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped") | final.isNull(), F.col("ceiling")).otherwise(final * F.col("weight"))
    return ranked.select("source", "rank", "source_size", "n_docs", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], key: list[str], value: str, seats: str, most: str) -> DataFrame:
    """Add ``quota``: Sainte-Lague seats of each party in its group, at most ``most``.

    Seat k of a party has the quotient value/(2k+1); the ``seats`` highest quotients win, ties by key. Two divisors
    bracket the result (rounding moves each party by half a seat at most), so only seats between the two
    allocations compete: about two rows a party, whatever the number of seats.
    """
    total = W.partitionBy(*group)
    v, s = F.sum(value).over(total), F.count(F.lit(1)).over(total)
    won = lambda d: F.floor((F.col(value) / d + 1) / 2)
    high = F.when(2 * F.col(seats) > s, v / (2 * F.col(seats) - s))
    base = F.least(F.coalesce(F.greatest(won(high) - 1, F.lit(0)), F.lit(0)), F.col(most)).cast("long")
    low = v / (2 * F.col(seats) + s)
    upper = F.least(F.when(v > 0, won(low) + 1).otherwise(F.lit(0)), F.col(most)).cast("long")
    held = parties.withColumn("base", base).withColumn("upper", F.greatest(upper, F.col("base")))
    held = held.withColumn("open", F.col(seats) - F.sum("base").over(total))
    runs = held.withColumn("seat", F.explode_outer(F.when(F.col("upper") > F.col("base"), F.sequence("base", F.col("upper") - 1))))
    quotient = F.col(value) / (2 * F.col("seat") + 1)
    place = F.row_number().over(total.orderBy(quotient.desc_nulls_last(), *key, "seat"))
    runs = runs.withColumn("wins", (F.col("seat").isNotNull() & (place <= F.col("open"))).cast("long"))
    return runs.groupBy(*parties.columns, "base").agg(F.sum("wins").alias("more")).select(
        *parties.columns, (F.col("base") + F.col("more")).alias("quota")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, shard, quota.

    Each source is dealt into shards by a seeded digest of the id; a shard's documents in digest order form a tape of
    words that is cut into equal blocks. Sources share out the blocks by Sainte-Lague, then each source's shards
    share out its quota the same way, never beyond ``most`` times the shard. A block has ``block_words`` words, fewer
    where the smallest target has not ``LEAST_BLOCKS`` of them, so that small sources are not rounded away. A shard takes whole laps of its
    tape first and the rest as consecutive blocks from a seeded block on, so a document gives at most
    ceil(``most``) times its size and the sum over a source is quota times block. Tapes are closed form: no block rows.

    Null text has size 0; the null source comes last in code point order and is a source like any other. Sources
    of size 0 get target and taken 0. Rows repeated with one id count as further documents. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = stash(rows, "mix-sizes")
    targets = source_targets(sizes, weights, share, most)
    n_shards = F.ceil(F.col("n_docs") / F.lit(shard_docs)).cast("long")
    targets = targets.withColumn("n_shards", n_shards)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.partitionBy())
    block = F.least(F.lit(block_words), F.greatest(F.floor(least / LEAST_BLOCKS), F.lit(1)))
    targets = targets.withColumn("block", F.coalesce(block, F.lit(block_words)).cast("long"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    placed = sizes.withColumn("digest", digest)
    placed = placed.join(targets, same(placed, targets)).drop(targets["source"])
    placed = placed.withColumn("shard", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % F.col("n_shards"))

    shards = placed.groupBy("rank", "shard", "source_size", "target", "block").agg(F.sum("size").alias("shard_size"))
    shards = shards.withColumn("most_blocks", F.floor(F.col("shard_size") * F.lit(float(most)) / F.col("block")).cast("long"))
    sources = shards.groupBy("rank", "target", "block").agg(F.sum("most_blocks").alias("most_blocks"))
    sources = sources.withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / F.col("block")).cast("long")).withColumn("all", F.lit(1))
    won = apportion(sources, ["all"], ["rank"], "target", "seats", "most_blocks").select("rank", F.col("quota").alias("seats"))
    fair = F.when(F.col("source_size") > 0, F.col("target") * F.col("shard_size") / F.col("source_size")).otherwise(F.lit(0.0))
    quotas = apportion(shards.join(won, "rank").withColumn("fair", fair), ["rank"], ["shard"], "fair", "seats", "most_blocks")
    quotas = quotas.select("rank", "shard", "shard_size", "quota", F.col("block").alias("own_block"))

    tape = W.partitionBy("rank", "shard").orderBy("digest", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = placed.withColumn("stop", F.sum("size").over(tape)).withColumn("start", F.col("stop") - F.col("size"))
    laid = laid.join(quotas, ["rank", "shard"])
    words = F.col("quota") * F.col("own_block")
    laps = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    laid = laid.withColumn("laps", laps).withColumn("rest", words - F.col("laps") * F.col("shard_size"))
    blocks = F.greatest(F.floor(F.col("shard_size") / F.col("own_block")), F.lit(1)).cast("long")
    first = (_draw(F.lit(str(seed)), F.col("rank").cast("string"), F.col("shard").cast("string")) % blocks) * F.col("own_block")
    laid = laid.withColumn("first", first).withColumn("last", F.col("first") + F.col("rest"))
    cut = lambda lo, hi: F.greatest(F.least(F.col("stop"), hi) - F.greatest(F.col("start"), lo), F.lit(0))
    taken = F.col("laps") * F.col("size") + cut(F.col("first"), F.least("last", "shard_size")) + cut(F.lit(0), F.col("last") - F.col("shard_size"))
    return laid.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), "shard", "quota")
