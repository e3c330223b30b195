"""Suffix-array dedup over bytes: threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.passages import BASES, Rolling, remove_repeats, removed_runs, repeats, texts_with, witnesses

#: Window and anchor in bytes; windows of a text that are handled at once.
WINDOW, GRAM, CHUNK = 200, 32, 1 << 22
#: Bytes of text that one Burrows-Wheeler transform holds, about.
BLOCK = 1 << 17
#: Different segments around one anchor that are held in one task at most; where there are more, windows meet by their hashes.
CROWD = 1500

_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _rolling(data: bytes) -> Rolling:
    return Rolling(_TABLE[np.frombuffer(data, np.uint8)])


def minimizers(roll: Rolling, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first start, number of starts: each window stands under the leftmost least hash of its 32-byte grams."""
    found = []
    for at in range(0, n - WINDOW + 1, CHUNK):
        windows = min(CHUNK, n - WINDOW + 1 - at)
        place = np.arange(at, at + windows + WINDOW - GRAM)
        hashes = roll(place, place + GRAM)
        order = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(place), dtype=np.uint64)
        width, span = 1, WINDOW - GRAM + 1
        while 2 * width <= span:
            order = np.minimum(order[:-width], order[width:])
            width *= 2
        order = np.minimum(order[:windows], order[span - width : span - width + windows])
        anchor = (order & np.uint64((1 << 24) - 1)).astype(np.int64) + at
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        found.append((anchor[first], first + at, np.diff(np.r_[first, windows])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, owners, places = [], [], []
        for dkey, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_buffer().to_pybytes()
            if len(data) < WINDOW:
                continue
            roll = _rolling(data)
            at = minimizers(roll, len(data))[0]
            keys.append(roll(at, at + GRAM))
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


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for dkey, version, text, found in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
            data = text.as_buffer().to_pybytes()
            if len(data) < WINDOW:
                continue
            roll = _rolling(data)
            at, lo, n = minimizers(roll, len(data))
            some = np.isin(at, np.array(found.values.to_numpy(), np.int64))
            at, lo, n = at[some], lo[some], n[some]
            stop = lo + n - 1 + WINDOW
            shape = ((at - lo) * 1024 + n).astype(np.uint64)
            s1 = roll(lo, stop) + shape * BASES[0]
            same = np.zeros(len(at), np.int64)
            rows.append((roll(at, at + GRAM, 1).view(np.int64), s1.view(np.int64), same + dkey.as_py(), same + version.as_py(), at, lo, n))
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0, np.int64)] * 7
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c) for c in columns[:4]), *(pa.array(c.astype(np.int32)) for c in columns[4:])],
            names=["akey", "s1", "dkey", "version", "pos", "lo", "n"],
        )


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of the folded segments."""
    names = ["akey", "s1", "weight", "content"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for version, text, folded in zip(*(batch.column(i) for i in range(2, 5)), strict=True):
            data = text.as_buffer().to_pybytes()
            for p in folded.as_py():
                if p["version"] != version.as_py():
                    continue
                lo, hi = p["lo"], p["lo"] + p["n"]
                for column, value in zip(out, (p["akey"], p["s1"], p["weight"], data[lo : hi - 1 + WINDOW]), strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the folded segments: its hash, whether it is known to repeat, where it starts in its segment."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        key, known, akey, s1, at = (np.concatenate(c) for c in zip(*rows, strict=True))
        again, many = witnesses(key)
        columns = [pa.array(key.view(np.int64)), pa.array(many | known), pa.array(again), pa.array(akey), pa.array(s1), pa.array(at.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "many", "again", "akey", "s1", "at"])

    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for version, text, folded in zip(*(batch.column(i) for i in range(2, 5)), strict=True):
            own = [p for p in folded.as_py() if p["version"] == version.as_py()]
            if not own:
                continue
            roll = _rolling(text.as_buffer().to_pybytes())
            for p in own:
                at = np.arange(p["n"])
                start = p["lo"] + at
                key = roll(start, start + WINDOW) ^ roll(start, start + WINDOW, 1) * BASES[0]
                rows.append((key, np.full(len(at), p["weight"] > 1), np.full(len(at), p["akey"]), np.full(len(at), p["s1"]), at))
                size += len(at)
            if size >= CHUNK // 8:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)


def _suffix_order(codes: np.ndarray) -> np.ndarray:
    """Suffixes in order of their first 256 codes at least, by doubling from groups of as many codes as 64 bits hold."""
    n = len(codes)
    bits = max(1, int(codes.max(initial=0)).bit_length())
    reach = min(256, 64 // bits)
    padded = np.r_[codes, np.zeros(reach, codes.dtype)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(reach):
        key = key << np.uint64(bits) | padded[i : n + i]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        fresh = np.r_[0, (ranked[1:] != ranked[:-1]).astype(np.int64)]
        rank[order] = np.cumsum(fresh)
        if reach >= 256 or int(fresh.sum()) == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (n + 1) + after
        reach *= 2


def repeated_starts(texts: list[bytes], weights: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each text, whether the window from each place also starts elsewhere (a weight over 1 is elsewhere, too).

    Prefixes that neighbours in the suffix array share are derived by increasing length: every border between
    suffixes with a common prefix of n bytes is extended backwards by each byte through the rank table of the
    transform, and the borders it reaches for the first time share n+1. Expansion ends at ``window``; borders it
    has not reached lie inside intervals of suffixes that share a whole window. Each border is extended once.
    """
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    codes = data.astype(np.int64) + len(texts)
    codes[ends] = np.arange(len(texts))  # each end is a symbol of its own, below all bytes
    order = _suffix_order(codes)
    n = len(codes)
    before = codes[order - 1]
    firsts = codes[order]
    border = firsts[1:] != firsts[:-1]
    common = np.full(n, window, np.int32)
    reached = np.r_[True, border]
    alphabet = np.unique(data[np.setdiff1d(np.arange(n), ends, assume_unique=True)]) if n > len(texts) else np.empty(0, np.uint8)
    amounts = np.bincount(data, minlength=256)
    common_bytes = alphabet[amounts[alphabet] > n // 400]
    ranks = np.empty((len(common_bytes), n + 1), np.int32)
    for i, byte in enumerate(common_bytes):
        code = int(byte) + len(texts)
        ranks[i, 0] = 0
        np.cumsum(before == code, out=ranks[i, 1:])
        ranks[i] += np.searchsorted(firsts, code)
    # Rare bytes have few borders: for each, the stretch of borders of which the first reached one extends to it.
    lows, highs, targets = [], [], []
    for byte in np.setdiff1d(alphabet, common_bytes):
        code = int(byte) + len(texts)
        at = np.flatnonzero(before == code)
        lows.append(at[:-1])
        highs.append(at[1:])
        targets.append(np.searchsorted(firsts, code) + np.arange(1, len(at)))
    low, high, target = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (lows, highs, targets))
    level = np.flatnonzero(reached)
    common[level] = 0
    stamp = np.empty(n + 1, np.int64)
    for length in range(1, window):
        following = ranks[:, level].ravel()
        following = following[following < n]
        following = following[~reached[following]]
        hit = np.searchsorted(level, low, "right") < np.searchsorted(level, high, "right")
        following = np.concatenate([following, target[hit]])
        if hit.any():
            low, high, target = low[~hit], high[~hit], target[~hit]
        number = np.arange(len(following))
        stamp[following] = number
        level = following[stamp[following] == number]
        if not len(level):
            break
        level.sort()
        reached[level] = True
        common[level] = length
    owner = np.repeat(np.arange(len(texts)), lengths + 1)[order]
    first = np.flatnonzero(reached)
    runs = np.diff(np.r_[first, n])
    total = np.add.reduceat(weights[owner], first)
    full = np.zeros(n, bool)
    full[order] = np.repeat(total > 1, runs)
    starts = ends - lengths
    return [full[s : s + max(0, size - window + 1)] for s, size in zip(starts, lengths, strict=True)]


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by akey, an anchor's rows (``CROWD`` at most) in one transform with its neighbours'."""

    def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        texts = table["content"].to_pylist()
        key = table["akey"].to_numpy()
        sizes = np.array([len(t) + 1 for t in texts])
        edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        s1, weight = (table[c].to_numpy() for c in ("s1", "weight"))
        volume = np.r_[0, np.cumsum(sizes)]
        i = 0
        while i < len(edges) - 1:
            j = i + 1
            while j < len(edges) - 1 and volume[edges[j + 1]] - volume[edges[i]] <= BLOCK:
                j += 1
            a, b = edges[i], edges[j]
            marks = repeated_starts(texts[a:b], weight[a:b])
            some = [k for k, m in enumerate(marks) if m.any()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[a:b][some]),
                    pa.array(s1[a:b][some]),
                    pa.array([len(marks[k]) for k in some], pa.int32()),
                    pa.array([np.packbits(marks[k]).tobytes() for k in some], pa.binary()),
                ],
                names=["akey", "s1", "n", "bits"],
            )
            i = j

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < 4 * BLOCK:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = whole.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield from done([whole.slice(0, last)])
        held, size = [whole.slice(last)], 0
    if held:
        yield from done(held)


def _look_into(source: DataFrame, told: DataFrame) -> DataFrame:
    """akey, s1, marks: a bit for each of n starts from the segment's start plus shift."""
    piece = F.struct("version", "akey", "s1", "weight", "pos", "lo", "n")
    per_doc = lambda rows: texts_with(source, rows.groupBy("dkey").agg(F.collect_list(piece).alias("folded")))
    contents = per_doc(told.where(F.col("variants") <= CROWD)).mapInArrow(_contents, "akey long, s1 long, weight long, content binary")
    hits = contents.repartition("akey").sortWithinPartitions("akey").mapInArrow(_expand, "akey long, s1 long, n int, bits binary")
    marks = hits.select("akey", "s1", F.struct(F.lit(0).alias("shift"), "n", "bits").alias("marks"))
    crowded = told.where(F.col("variants") > CROWD)
    if crowded.isEmpty():
        return marks
    hashed = per_doc(crowded).mapInArrow(_hashed, "key long, many boolean, again boolean, akey long, s1 long, at int")
    # Eight starts make a byte; the first is its highest bit.
    octets = repeats(hashed).groupBy("akey", "s1", (F.expr("at DIV 8") * 8).cast("int").alias("shift")).agg(F.expr("bit_or(shiftright(128, at % 8))").alias("octet"))
    bits = F.unhex(F.lpad(F.hex("octet"), 2, "0")).alias("bits")
    return marks.union(octets.select("akey", "s1", F.struct("shift", F.lit(8).alias("n"), bits).alias("marks")))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, digests = [], [], [], []
        for version, text, found in zip(*(batch.column(i) for i in range(2, 5)), strict=True):
            data = text.as_buffer().to_pybytes()
            start = np.empty(0, np.int64)
            if found.is_valid:
                rows = found.values
                marks = rows.field(2)
                n, shift = marks.field(1).to_numpy().astype(np.int64), marks.field(0).to_numpy()
                base = (rows.field(1).to_numpy() + shift).astype(np.int64)
                n = np.where(rows.field(0).to_numpy() == version.as_py(), n, 0)
                parts = marks.field(2).to_pylist()
                width = np.array([len(p) for p in parts]) * 8
                bit = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(parts), np.uint8)))
                row = np.repeat(np.arange(len(parts)), width)[bit]
                place = bit - (np.cumsum(width) - width)[row]
                fits = place < n[row]
                start = base[row[fits]] + place[fits]
            if len(start):
                edges = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + WINDOW, minlength=len(data) + 1)
                covered = np.add.accumulate(edges[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
                spans.append(removed_runs(covered))
            else:
                kept = data
                spans.append(0)
            sizes.append(len(data))
            removed.append(len(data) - len(kept))
            digests.append(hashlib.sha256(kept).hexdigest())
        columns = [*(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: bytes covered by a 200-byte string that also starts elsewhere go.

    Windows stand under their minimizer; those whose minimizer's hash occurs once are settled. The rest are
    dealt out by it, so equal windows meet, and within a block of segments (128 KB, each ended by a symbol of its
    own, so matches never cross documents) common prefixes are derived on a Burrows-Wheeler transform. Equal
    segments fold first. Where an anchor has more than ``CROWD`` segments that differ, no task holds them: their windows
    are dealt out by 64 bits mixed from two hashes of the whole 200 bytes and met in a stream.

    Null text has no bytes; texts under 200 bytes lose nothing and match nothing. Rows repeated with the same id and
    text are further documents and remove each other. Ids may be null and of any type. An empty table gives an empty result.
    """
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    ones = F.unhex(F.repeat(F.lit("FF"), F.ceil(F.col("n") / 8).cast("int")))
    whole = F.struct(F.lit(0).alias("shift"), F.col("n").alias("n"), ones.alias("bits"))
    return remove_repeats(docs, _anchors, _occurrences, _look_into, whole, _apply, schema, id_col, text_col, "suffixes")
