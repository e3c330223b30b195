"""Filter interaction audit: packed bitmaps of filters and labels, counted for every prefix of every filter order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.batches import pieces, small_batches
from umbra.shared import stash

#: The filters by letter; a document fails A under 100 words, B with under 80 different words of 100, C with more than
#: 10 capitals of 100 characters, D with a symbol, E if its text has been seen under a smaller id.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10

_CAPITALS, _SYMBOLS, _TAILS = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
#: Parts whose counts a task holds before it hands them on.
MOST_PARTS = 4096


def failures(data: bytes) -> int:
    """Bits of the filters A to D (A lowest) that a UTF-8 text fails."""
    words = data.split()
    found = len(words) < LEAST_WORDS
    found |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    capitals, points = len(data) - len(data.translate(None, _CAPITALS)), len(data.translate(None, _TAILS))
    found |= (100 * capitals > MOST_CAPITALS * points) << 2
    return found | (len(data) != len(data.translate(None, _SYMBOLS))) << 3


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask, good, toxic: one row per document with the bits of the filters that it fails.

    One pass over the texts leaves 32 bytes of SHA-256 of each; groups of equal texts meet by these, combined inside
    map tasks, so a large group comes to the shuffle as one row a task. Only rows of some 60 bytes are joined.
    """
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2)]
            masks = pa.array([failures(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), masks, digests], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.encode(F.col(text_col), "utf-8").alias("text"))
    rows = stash(rows.mapInArrow(read, f"doc_id {id_type}, part string, mask int, digest binary"), "audit")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = rows.join(groups, "digest", "left").join(marks, F.col("doc_id") == F.col("labelled"), "left")
    later = F.col("first_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    mask = F.col("mask").bitwiseOR(F.when(later, 16).otherwise(0))
    return met.select("doc_id", "part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


class Bitmaps:
    """Bitmaps of some rows: filters, labels and parts in words of 64 rows, every part from a word of its own on."""

    def __init__(self, codes: np.ndarray, masks: np.ndarray, labels: list[np.ndarray], n_filters: int):
        order = np.argsort(codes, kind="stable")
        self.parts, sizes = np.unique(codes, return_counts=True)
        words = -(-sizes // 64)
        self.starts = np.cumsum(words) - words
        place = np.arange(len(codes)) + np.repeat(self.starts * 64 - (np.cumsum(sizes) - sizes), sizes)

        def packed(bits: np.ndarray) -> np.ndarray:
            spread = np.zeros(int(words.sum()) * 64, bool)
            spread[place] = bits[order]
            return np.packbits(spread).view(np.uint64)

        self.part = packed(np.ones(len(codes), bool))
        self.filters = [packed(masks >> i & 1 == 1) for i in range(n_filters)]
        self.labels = [packed(label) for label in labels]

    def counted(self, words: np.ndarray) -> np.ndarray:
        """Set bits by part."""
        return np.add.reduceat(np.bitwise_count(words).astype(np.int64), self.starts)


def prefix_filter_pairs(n_filters: int) -> list[tuple[int, int]]:
    """Every set of filters with every filter outside it."""
    return [(prefix, f) for prefix in range(1 << n_filters) for f in range(n_filters) if not prefix >> f & 1]


def prefix_counts(rows: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """part, prefix, filter, alive, removed, good_lost, toxic_lost of rows (part, mask, good, toxic).

    ``prefix`` has the bits of filters applied before; alive are the rows that fail none of these, removed those of them
    that fail ``filter``. Each task counts its own bitmaps and sends n_filters * 2 ** (n_filters - 1) rows a part.
    """
    pairs = prefix_filter_pairs(n_filters)

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            flags = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            index = Bitmaps(names.indices.to_numpy(), flags[0], flags[1:], n_filters)
            found = np.empty((len(pairs), 4, len(index.parts)), np.int64)
            for at, (prefix, f) in enumerate(pairs):
                gone = np.zeros_like(index.part)
                for g in range(n_filters):
                    if prefix >> g & 1:
                        gone |= index.filters[g]
                alive = index.part & ~gone
                removed = alive & index.filters[f]
                found[at] = [index.counted(alive), index.counted(removed), *(index.counted(removed & label) for label in index.labels)]
            for i, part in enumerate(index.parts):
                name = names.dictionary[int(part)].as_py()
                totals[name] = totals.get(name, 0) + found[:, :, i]
            if len(totals) >= MOST_PARTS:
                yield from sent(totals)
                totals = {}
        yield from sent(totals)

    def sent(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, counts in totals.items():
            prefixes, filters = zip(*pairs, strict=True)
            columns = [pa.array([name] * len(pairs)), pa.array(prefixes, pa.int32()), pa.array(filters, pa.int32()), *(pa.array(c) for c in counts.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "prefix", "filter", "alive", "removed", "good_lost", "toxic_lost"])

    schema = "part string, prefix int, filter int, alive long, removed long, good_lost long, toxic_lost long"
    sums = [F.sum(c).alias(c) for c in ("alive", "removed", "good_lost", "toxic_lost")]
    return rows.select("part", "mask", "good", "toxic").mapInArrow(tallied, schema).groupBy("part", "prefix", "filter").agg(*sums)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters are applied from left to right; kept counts the part's documents after the step. ``labels`` has doc_id,
    quality and toxic; repeated label rows count once, as 1 if any of them is 1,
    and those without an id label nothing. shapley is the sum over all orders of what the filter
    removes.

    Null text counts as empty, a null part as ''. Rows repeated with one id are documents of their own, of which none
    is a copy of another; a row without an id is a copy of any equal text that has one. An empty table gives an
    empty result. Further columns are ignored.
    """
    n = len(FILTERS)
    counts = stash(prefix_counts(judged(docs, labels, id_col, text_col, part_col)), "audit-counts")
    before = F.bit_count("prefix")
    weight = F.when(before < 0, 0)
    for size in range(n):
        weight = weight.when(before == size, factorial(size) * factorial(n - 1 - size))
    whole = counts.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(before == n - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(weight * F.col("removed")).alias("shapley"),
    )
    steps = []
    for order in permutations(range(n)):
        name = "".join(FILTERS[f] for f in order)
        steps += [(name, step + 1, sum(1 << f for f in order[:step]), f) for step, f in enumerate(order)]
    table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, prefix int, filter int")
    return (
        counts.join(whole, ["part", "filter"])
        .join(F.broadcast(table), ["prefix", "filter"])
        .select(
            "part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed",
            (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
        )
    )
