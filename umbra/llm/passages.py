"""What the two operators on repeated passages share: anchors, the ones that repeat, and marks brought back to documents.

Both look for windows (of words or of bytes) whose content also starts elsewhere, in four steps:

1. Every document names *anchors*, positions chosen so that equal windows share an equal anchor at an equal offset.
2. Anchors whose hash occurs once are dropped; most text ends here.
3. Around each anchor left, a *segment* holds all windows that the anchor stands for. Equal segments fold into one
   with a weight, and where an anchor has segments that differ, one of each is looked into.
4. The windows found to repeat are marked in all occurrences of their segments, and documents drop what marked
   windows cover.

What each step finds is written to the shared folder, which ends the shuffles behind it. Text is dealt out by document
key twice: to make segments, and to look into them and remove what repeats, which reuse one exchange. No step gathers a key's
rows in memory: repeats are found in a stream sorted by key, and where a task meets a key again, all but
the first of its rows go to a task drawn at random, already known to repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.batches import small_batches
from umbra.shared import stash

#: Odd bases of two polynomial hashes modulo 2**64 and their inverses.
BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))
INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses up to n, kept by the worker up to the longest text seen."""
    if not _powers or len(_powers[0][0]) <= n:
        _powers.clear()
        for pair in zip(BASES, INVERSES, strict=True):
            rows = []
            for value in pair:
                row = np.full(max(n, 1 << 16) + 1, value, np.uint64)
                row[0] = 1
                rows.append(np.multiply.accumulate(row))
            _powers.append((rows[0], rows[1]))
    return _powers


class Rolling:
    """Two hashes of any range of a sequence of 64-bit values in constant time, by prefix sums of value * base**place."""

    def __init__(self, values: np.ndarray):
        self.values, self.powers, self.sums = values, powers(len(values)), [None, None]

    def __call__(self, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
        sums = self.sums[which]
        if sums is None:
            own = self.values if which == 0 else (self.values ^ self.values >> np.uint64(31)) * BASES[0]
            sums = self.sums[which] = np.zeros(len(own) + 1, np.uint64)
            np.add.accumulate(own * self.powers[which][0][: len(own)], out=sums[1:])
        out = (sums[hi] - sums[lo]) * self.powers[which][1][lo]
        out ^= out >> np.uint64(32)
        return out * BASES[1]


def witnesses(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row's key came before in this batch, and whether it is known to repeat."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:]] = same
    many = again.copy()
    many[order[:-1]] |= same
    return again, many


def repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, many, payload ...) sorted by key: those whose key occurs twice, or that are known to repeat."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key, many = (whole.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        same = key[1:] == key[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        start = len(key) - 1
        while start > 0 and same[start - 1]:
            start -= 1
        run_many = bool(many[start:].any())
        # `many` of one row speaks for its whole run
        runs = np.r_[0, np.flatnonzero(~same) + 1]
        known = np.repeat(np.logical_or.reduceat(many, runs), np.diff(np.r_[runs, len(key)]))
        if len(key) - start > 1 or run_many:  # settled: later rows of this key need only one of these beside them
            yield pa.RecordBatch.from_arrays(whole.filter(pa.array(keep | known)).columns[2:], names=whole.schema.names[2:])
            held = whole.slice(start, 1)
            held = pa.RecordBatch.from_arrays([held.column(0), pa.array([True]), *held.columns[2:]], schema=held.schema)
        else:
            out = keep | known
            out[start:] = False
            yield pa.RecordBatch.from_arrays(whole.filter(pa.array(out)).columns[2:], names=whole.schema.names[2:])
            held = whole.slice(start)
    if held is not None and held.column(1)[0].as_py():
        yield pa.RecordBatch.from_arrays(held.columns[2:], names=held.schema.names[2:])


def repeats(rows: DataFrame) -> DataFrame:
    """Payload of the rows (key, many, again, payload ...) whose key occurs more than once; some come twice."""
    payload = rows.columns[3:]
    kinds = dict(rows.dtypes)
    place = F.when(F.col("again"), F.xxhash64(*payload)).otherwise(F.col("key"))
    dealt = rows.repartition(place).sortWithinPartitions("key").drop("again")
    return dealt.mapInArrow(repeating, ", ".join(f"{c} {kinds[c]}" for c in payload))


def keyed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, dkey, version and text as bytes.

    dkey is a hash of id and text and version one of the text from another seed, 128 bits in all, so rows that share both are
    repeats of one document; rows without an id are told apart by their texts, and ids may be of any type.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.lit(1), F.col(id_col), text).alias("dkey"),
        F.xxhash64(F.lit(2), text).alias("version"),
        F.encode(text, "utf-8").alias("text"),
    )


def texts_with(source: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """Documents joined with what is known of them. The side is hashed; texts are not sorted.

    Every use takes all columns of the documents, so the plan deals the texts out once and reuses that.
    """
    return source.join(side.hint("shuffle_hash"), "dkey", how).select("doc_id", "dkey", "version", "text", *side.columns[1:])


def removed_runs(covered: np.ndarray) -> int:
    return int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()) if len(covered) else 0


def remove_repeats(
    docs: DataFrame,
    anchors: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    occurrences: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    look_into: Callable[[DataFrame, DataFrame], DataFrame],
    whole: Column,
    apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    result: str,
    id_col: str,
    text_col: str,
    tag: str,
) -> DataFrame:
    """The four steps; ``result`` is the schema that ``apply`` yields after doc_id, ``whole`` marks all n starts.

    A segment whose anchor has no other variant repeats as a whole or, where its weight is 1, not at all; only
    anchors with variants are looked into.
    """
    small_batches(docs.sparkSession)
    source = keyed_documents(docs, id_col, text_col)
    named = source.select("dkey", "text").mapInArrow(anchors, "key long, many boolean, again boolean, dkey long, pos int")
    left = stash(repeats(named), tag)
    positions = left.groupBy("dkey").agg(F.collect_set("pos").alias("positions"))
    segments = texts_with(source, positions).mapInArrow(
        occurrences, "akey long, s1 long, dkey long, version long, pos int, lo int, n int"
    )
    segments = stash(segments, tag)
    folded = segments.groupBy("akey", "s1").agg(
        F.count(F.lit(1)).alias("weight"), *(F.first(c).alias(c) for c in ("dkey", "version", "pos", "lo", "n"))
    )
    folded = stash(folded, tag)
    variants = folded.groupBy("akey").agg(F.count(F.lit(1)).alias("variants"))
    told = stash(folded.join(variants, "akey"), tag)
    settled = told.where("variants = 1 AND weight > 1").select("akey", "s1", whole.alias("marks"))
    marks = look_into(source, told.where("variants > 1")).union(settled)
    marked: Column = F.struct("version", "lo", "marks")
    back = segments.select("akey", "s1", "dkey", "version", "lo").join(marks, ["akey", "s1"])
    back = back.groupBy("dkey").agg(F.collect_set(marked).alias("found"))
    return texts_with(source, back, "left").mapInArrow(apply, f"doc_id {dict(docs.dtypes)[id_col]}, {result}")
