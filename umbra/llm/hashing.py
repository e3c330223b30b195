"""Hashed n-gram features of words, shared by the scoring operators."""

from __future__ import annotations

import numpy as np

#: Odd multipliers that mix a word's hash with its successor's.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash from two, dependent on their order."""
    out = left * MIX_A ^ right * MIX_B
    return out ^ out >> np.uint64(29)


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The top bits, as indices."""
    return (hashes * MIX_A >> np.uint64(64 - bits)).astype(np.int64)


def unigrams_and_bigrams(words: list[bytes], bits: int) -> np.ndarray:
    """Bucket of every word and of every pair of neighbours."""
    own = word_hashes(words)
    return np.concatenate([buckets(own, bits), buckets(mixed(own[:-1], own[1:]), bits)])
