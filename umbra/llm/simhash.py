"""SimHash near-deduplication with the pigeonring filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.batches import small_batches
from umbra.operators.components import connected_components
from umbra.shared import stash

#: Segments of eight bits on a ring, and the largest Hamming distance of a link.
SEGMENTS, MOST_BITS = 8, 3
#: Fingerprints that share a key and are compared in one tile at most.
TILE = 4096


def ring_chains() -> list[tuple[int, ...]]:
    """Segment sets of which two fingerprints within ``MOST_BITS`` share at least one, by the pigeonring principle.

    If the differences over all 8 segments sum to at most 3, there is a segment from which every chain of n
    consecutive segments has at most floor(3n/8) differing bits: none in the first two, at most one in the first
    five. One bit spoils one of segments three to five, so for one of 8 starts and 3 choices of the spoilt segment,
    the other four segments of the chain (32 bits) are equal. Longer chains are settled by the full check.
    """
    chains = []
    for start in range(SEGMENTS):
        ring = [(start + i) % SEGMENTS for i in range(5)]
        chains += [tuple(sorted(ring[:2] + [ring[i] for i in range(2, 5) if i != spoilt])) for spoilt in (2, 3, 4)]
    return list(dict.fromkeys(chains))


CHAINS = ring_chains()
MASKS = np.array([sum(0xFF << (8 * s) for s in chain) for chain in CHAINS], dtype=np.uint64)


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """SimHash of the UTF-8 text: majority of the XXH64 (seed 42) of word shingles, repeats included; 0 without words."""
    import xxhash

    words = data.lower().split()  # on bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return 0
    runs = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(run, 42) for run in runs), dtype="<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_buffer().to_pybytes() if text.is_valid else b"") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"))
    return rows.mapInArrow(made, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def ring_keys(fp: Column) -> Column:
    """An array of the chains' keys: the chain's number above its 32 bits."""
    keys = []
    for number, chain in enumerate(CHAINS):
        bits = F.lit(0).cast("long")
        for place, segment in enumerate(chain):
            bits = bits.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 8 * segment).bitwiseAND(F.lit(255).cast("long")), 8 * place))
        keys.append(bits.bitwiseOR(F.lit(number << 32).cast("long")))
    return F.array(*keys)


def _links_within(fps: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of a tile within reach of each other: a forest, not all pairs.

    A leader gathers what is within reach of it; members of two gatherings can be within reach only if the leaders
    are within three times the bound, and are compared only while the two are not connected yet.
    """
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right, leaders, gathered = [], [], [], []
    rest = np.arange(len(fps))
    while len(rest):
        leader = rest[0]
        near = np.bitwise_count(fps[rest] ^ fps[leader]) <= MOST_BITS
        for other in rest[near][1:]:
            left.append(leader)
            right.append(other)
        leaders.append(leader)
        gathered.append(rest[near])
        rest = rest[~near]
    heads = fps[np.array(leaders, dtype=np.int64)]
    for i in range(len(leaders)):
        for j in np.flatnonzero(np.bitwise_count(heads[:i] ^ heads[i]) <= 3 * MOST_BITS):
            if root(i) == root(int(j)):
                continue
            close = np.bitwise_count(fps[gathered[i]][:, None] ^ fps[gathered[j]][None, :]) <= MOST_BITS
            if close.any():
                a, b = np.unravel_index(int(close.argmax()), close.shape)
                left.append(gathered[i][a])
                right.append(gathered[j][b])
                parent[root(i)] = root(int(j))
    return ids[np.array(left, np.int64)], ids[np.array(right, np.int64)]


#: A group of up to so many rows is compared by shifting whole batches.
FEW = 24


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, tile, fp, rep) that come sorted by key and tile."""
    names = ["src", "dst"]
    held: tuple[np.ndarray, ...] | None = None

    def compare(key: np.ndarray, tile: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
        lengths = np.diff(np.r_[starts, len(key)])
        group = np.repeat(np.arange(len(starts)), lengths)
        few = lengths[group] <= FEW
        found_a, found_b = [], []
        for shift in range(1, min(FEW, int(lengths.max())) if len(lengths) else 1):
            same = np.flatnonzero((group[shift:] == group[:-shift]) & few[shift:])
            if not len(same):
                break
            apart = fp[same] ^ fp[same + shift]
            ok = np.bitwise_count(apart) <= MOST_BITS
            same, apart = same[ok], apart[ok]
            if len(same):  # only where this is the first chain that the pair shares
                first = ((apart[:, None] & MASKS[None, :]) == 0).argmax(axis=1)
                own = first == key[same] >> 32
                found_a.append(rep[same[own]])
                found_b.append(rep[same[own] + shift])
        for g in np.flatnonzero(lengths > FEW):
            part = slice(starts[g], starts[g] + lengths[g])
            a, b = _links_within(fp[part], rep[part])
            found_a.append(a)
            found_b.append(b)
        ends = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_a, found_b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=names)

    for batch in batches:
        columns = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if held is not None:
            columns = tuple(np.concatenate(x) for x in zip(held, columns, strict=True))
        if not len(columns[0]):
            continue
        key, tile = columns[0], columns[1]
        same = (key == key[-1]) & (tile == tile[-1])
        last = len(key) - int(same[::-1].argmin()) if not same.all() else 0
        held = tuple(x[last:] for x in columns)
        if last:
            yield compare(*(x[:last] for x in columns))
    if held is not None:
        yield compare(*held)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every document: components of fingerprints that differ in at most three bits.

    Equal fingerprints fold into one row first (the smallest id stands for them). Each distinct fingerprint is sent
    under the keys of its 24 ring chains; rows that share a key meet. A key that more than ``TILE`` fingerprints
    share is dealt into pairs of sub-groups, so a task holds a bounded tile whatever the key, and no pair is left
    out. A tile yields a spanning forest of its links, so dense groups don't turn into all pairs.

    Null text counts as empty: fingerprint zero, linked like any other. Texts of fewer than three words are one
    shingle. Rows with a null id get a fingerprint and a null component unless an equal or linked fingerprint has an
    id. Rows repeated with one id share its component. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    own = stash(fingerprints(docs, id_col, text_col), "simhash-fp")
    distinct = stash(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    keyed = distinct.where("rep IS NOT NULL").select(F.explode(ring_keys(F.col("fp"))).alias("key"), "fp", "rep")
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    crowded = crowded.select("key", F.ceil(F.col("n") / F.lit(TILE // 2)).cast("int").alias("parts"))
    placed = keyed.join(crowded, "key", "left")
    part = F.pmod(F.hash("fp"), F.col("parts"))
    tiles = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(part, j).cast("long") * F.lit(1 << 31) + F.greatest(part, j))
    )
    tiled = placed.select("key", F.explode(tiles).alias("tile"), "fp", "rep")
    links = tiled.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_links, "src long, dst long")
    components = connected_components(links)
    labelled = distinct.join(components, distinct["rep"] == components["node"], "left")
    labelled = labelled.select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    return own.join(labelled, own["fp"] == labelled["of"]).select("doc_id", "fp", "component_id")
