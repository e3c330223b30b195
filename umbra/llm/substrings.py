"""Substring dedup over words: difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.hashing import word_hashes
from umbra.llm.passages import BASES, Rolling, remove_repeats, repeats, texts_with, witnesses

#: Window in words; period and a difference cover of it: every residue is a difference of two of these.
WINDOW, PERIOD, COVER = 35, 21, (0, 1, 4, 14, 16)
#: Words that an anchor hashes: what every window holds from its aligned cover position on.
REACH = WINDOW - PERIOD + 1
#: Different segments of one anchor that are compared in one task at most.
CROWD = 20_000


def _cover_positions(n: int) -> np.ndarray:
    blocks = np.arange(0, n - REACH + 1, PERIOD)[:, None] + np.array(COVER)[None, :]
    blocks = blocks.ravel()
    return blocks[blocks <= n - REACH]


def _starts(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows that hold an anchor's words."""
    return np.maximum(at - PERIOD + 1, 0), np.minimum(at, n - WINDOW)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, owners, places = [], [], []
        for dkey, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = text.as_buffer().to_pybytes().split()
            if len(words) < WINDOW:
                continue
            at = _cover_positions(len(words))
            keys.append(Rolling(word_hashes(words))(at, at + REACH))
            owners.append(np.full(len(at), dkey, np.int64))
            places.append(at)
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        at = np.concatenate(places) if places else np.empty(0, np.int64)
        again, many = witnesses(key)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(many), pa.array(again), pa.array(owner), pa.array(at.astype(np.int32))],
            names=["key", "many", "again", "dkey", "pos"],
        )


def _positions(values, n: int) -> np.ndarray:
    at = np.sort(np.array(values.values.to_numpy(), np.int64))
    at = at[(at + REACH <= n) & np.isin(at % PERIOD, COVER)]
    lo, hi = _starts(at, n)
    return at[lo <= hi]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for dkey, version, text, found in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
            words = text.as_buffer().to_pybytes().split()
            n = len(words)
            at = _positions(found, n) if n >= WINDOW else np.empty(0, np.int64)
            if not len(at):
                continue
            roll = Rolling(word_hashes(words))
            lo, hi = _starts(at, n)
            stop = hi + WINDOW
            shape = ((at - lo) * 64 + (hi - lo)).astype(np.uint64)
            s1 = roll(lo, stop) + shape * BASES[0]
            same = np.full(len(at), 0, np.int64)
            rows.append((roll(at, at + REACH, 1).view(np.int64), s1.view(np.int64), same + dkey.as_py(), same + version.as_py(), at, lo, hi - lo + 1))
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0, np.int64)] * 7
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c) for c in columns[:4]), *(pa.array(c.astype(np.int32)) for c in columns[4:])],
            names=["akey", "s1", "dkey", "version", "pos", "lo", "n"],
        )


def _window_keys(words: list[bytes], pieces: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of every window of the segments (content and offset from the anchor), its start in the segment, its segment."""
    roll = Rolling(word_hashes(words))
    n = np.array([p["n"] for p in pieces])
    lo = np.repeat(np.array([p["lo"] for p in pieces]), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = lo + offset
    stands = (np.repeat(np.array([p["pos"] for p in pieces]), n) - start).astype(np.uint64)
    keys = roll(start, start + WINDOW) ^ (roll(start, start + WINDOW, 1) + stands) * BASES[0]
    return keys, offset, np.repeat(np.arange(len(pieces)), n)


def _own(version, folded) -> list[dict]:
    return [p for p in folded.as_py() if p["version"] == version.as_py()]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment with its windows' keys."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for version, text, folded in zip(*(batch.column(i) for i in range(2, 5)), strict=True):
            if pieces := _own(version, folded):
                keys, _, _ = _window_keys(text.as_buffer().to_pybytes().split(), pieces)
                at = 0
                for p in pieces:
                    row = (p["akey"], p["s1"], p["weight"], keys[at : at + p["n"]].tobytes())
                    at += p["n"]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["akey", "s1", "weight", "keys"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: which windows repeat among the segments of their anchor."""

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch:
        anchor, s1, weight = (rows.column(i).to_numpy() for i in range(3))
        sizes = np.diff(np.frombuffer(rows.column(3).buffers()[1], np.int32)[rows.column(3).offset :][: len(rows) + 1]) // 8
        keys = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint64)
        row = np.repeat(np.arange(len(rows)), sizes)
        _, place, times = np.unique(keys + anchor[row].view(np.uint64) * BASES[1], return_inverse=True, return_counts=True)
        total = np.zeros(len(times), np.int64)
        np.add.at(total, place, weight[row])
        offset = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        marks = np.zeros(len(rows), np.int64)
        np.bitwise_or.at(marks, row, np.where(total[place] > 1, np.int64(1) << offset, 0))
        some = np.flatnonzero(marks)
        return pa.RecordBatch.from_arrays([pa.array(anchor[some]), pa.array(s1[some]), pa.array(marks[some])], names=["akey", "s1", "marks"])

    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        anchor = whole.column(0).to_numpy()
        last = len(anchor) - int((anchor[::-1] != anchor[-1]).argmax()) if (anchor != anchor[-1]).any() else 0
        if last:
            yield compare(whole.slice(0, last))
        held = whole.slice(last)
    if held is not None:
        yield compare(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the segments."""
    for batch in batches:
        parts = []
        for version, text, folded in zip(*(batch.column(i) for i in range(2, 5)), strict=True):
            if pieces := _own(version, folded):
                keys, offset, of = _window_keys(text.as_buffer().to_pybytes().split(), pieces)
                field = lambda name, of=of, pieces=pieces: np.array([p[name] for p in pieces], np.int64)[of]
                parts.append((keys, field("weight") > 1, field("akey"), field("s1"), offset.astype(np.int32)))
        kinds = (np.uint64, bool, np.int64, np.int64, np.int32)
        key, heavy, akey, s1, offset = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, k) for k in kinds)
        again, many = witnesses(key)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(heavy | many), pa.array(again), pa.array(akey), pa.array(s1), pa.array(offset)],
            names=["key", "many", "again", "akey", "s1", "off"],
        )


def _look_into(source: DataFrame, told: DataFrame) -> DataFrame:
    """akey, s1, marks: a bit for each start of the segment whose window repeats.

    The segments of an anchor meet in one task; where more than ``CROWD`` of them differ, each window is sent by itself.
    """
    piece = F.struct("version", "akey", "s1", "weight", "pos", "lo", "n")

    def texts(some: DataFrame) -> DataFrame:
        return texts_with(source, some.groupBy("dkey").agg(F.collect_list(piece).alias("folded")))

    packed = texts(told.where(F.col("variants") <= CROWD)).mapInArrow(_packed, "akey long, s1 long, weight long, keys binary")
    compared = packed.repartition("akey").sortWithinPartitions("akey").mapInArrow(_compared, "akey long, s1 long, marks long")
    alone = texts(told.where(F.col("variants") > CROWD)).mapInArrow(_windows, "key long, many boolean, again boolean, akey long, s1 long, off int")
    hits = repeats(alone).groupBy("akey", "s1").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("marks"))
    return compared.union(hits)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.arange(PERIOD, dtype=np.int64)
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for version, text, found in zip(*(batch.column(i) for i in range(2, 5)), strict=True):
            words = text.as_buffer().to_pybytes().split()
            edges = np.zeros(len(words) + 1, np.int64)
            if found.is_valid:
                fields = found.values
                own = fields.field(0).to_numpy() == version.as_py()
                lo = fields.field(1).to_numpy()[own].astype(np.int64)
                marks = fields.field(2).to_numpy()[own]
                row, bit = np.nonzero(marks[:, None] >> bits[None, :] & 1)
                start = np.unique(lo[row] + bit)
                edges[start] += 1
                edges[start + WINDOW] -= 1
            covered = np.add.accumulate(edges[:-1]) > 0
            kept = words if not covered.any() else [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words covered by a window of 35 words that also starts elsewhere go.

    A word sequence is hashed only at positions that a difference cover modulo 21 names (5 of 21). Two equal
    windows, wherever they start, have such a position at the same offset of at most 20, so they share the
    hash of the 15 words from there. Around positions whose hash repeats, the windows themselves are
    compared by their hash and offset.

    Null text has no words; documents of fewer than 35 words lose nothing and match nothing. Rows repeated with the
    same id and text are further documents and remove each other. Ids may be null and of any type. An empty table gives an
    empty result.
    """
    return remove_repeats(
        docs, _anchors, _occurrences, _look_into, F.expr("shiftleft(1L, n) - 1L"), _apply, "n_words long, n_removed long, kept_sha256 string", id_col, text_col, "substrings"
    )
