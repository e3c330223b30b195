"""Quality rules: counting rules and a hashed n-gram log-likelihood ratio of trusted target to raw corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.batches import small_batches
from umbra.llm.hashing import mixed, unigrams_and_bigrams, word_hashes
from umbra.shared import within

#: Hash bits of the n-gram buckets, and the length-normalised ratio (nats per n-gram) from which a document is kept.
BITS, THRESHOLD = 14, -0.08
#: N-grams a bucket of the raw distribution that the target multinomial starts from (its prior).
PRIOR = 8.0

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_SYMBOLS = b"#*$%&|<>"


def rules(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    chars = sum(len(w) for w in words)
    word_chars = chars if data.isascii() else len(b"".join(words).decode("utf-8"))
    n_symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    n_repeat = 0
    if len(words) >= 4:
        own = word_hashes(words)
        windows = mixed(mixed(own[:-2], own[1:-1]), own[2:])
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(windows), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(len(words), bool)
        for shift in range(3):
            covered[shift : shift + len(again)] |= again
        n_repeat = int(covered.sum())
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat


def _bytes(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"), *more)


def ngram_counts(docs: DataFrame, text_col: str, trusted_col: str, bits: int = BITS) -> DataFrame:
    """bucket, raw, target: n-grams of all rows and of the trusted rows. Each task adds up before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text, trusted in zip(batch.column(1), batch.column(2), strict=True):
                found = np.bincount(unigrams_and_bigrams(text.as_buffer().to_pybytes().split(), bits), minlength=1 << bits) if text.is_valid else 0
                raw += found
                if trusted.as_py():
                    target += found
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    rows = _bytes(docs, text_col, text_col, F.coalesce(F.col(trusted_col), F.lit(False)).alias("trusted"))
    parts = rows.mapInArrow(counted, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratio_weights(counts: DataFrame, bits: int = BITS) -> np.ndarray:
    """Log ratio of the two smoothed multinomials by bucket; at most 2**bits rows reach the driver."""
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for bucket, r, t in counts.toPandas().itertuples(index=False):
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(1 << bits, np.float32)
    shared = (raw + 1) / (raw.sum() + len(raw))
    prior = PRIOR * len(raw)
    return np.log((target + prior * shared) / (target.sum() + prior) / shared).astype(np.float32)


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    ``trusted`` has the ids of trusted documents. One pass counts hashed words and pairs of all rows and of the
    trusted ones; the table of ratios has a fixed size (2**bits floats), whatever the corpus, and goes to the tasks. A second pass
    scores every document: the mean ratio of its n-grams, and keeps it if no base rule failed and the mean is at
    least ``threshold``. Nothing is drawn at random; equal texts get equal verdicts.

    Null text has no words and fails the base rules. Without any trusted document every ratio is zero. Repeated ids
    in ``trusted`` count once; repeated documents count each time. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    ids = trusted.select(F.col(id_col).alias("trusted_id")).distinct().withColumn("trusted", F.lit(True))
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = within(ids)
    marked = marked.join(ids, marked["doc_id"] == ids["trusted_id"], "left").select("doc_id", "text", "trusted")
    weights = ratio_weights(ngram_counts(marked, "text", "trusted", bits), bits)
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            found, ratios = [], []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes()
                words = data.split()
                found.append(rules(data, words))
                ratios.append(float(table[unigrams_and_bigrams(words, bits)].mean(dtype=np.float64)) if words else 0.0)
            columns = np.array(found, np.int64).reshape(-1, 5)
            failed = (columns[:, 0] < 50) | (100 * columns[:, 4] > 50 * columns[:, 0])
            kept = ~failed & (np.array(ratios) >= threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(columns[:, i]) for i in range(5)), pa.array(failed), pa.array(ratios, pa.float64()), pa.array(kept)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"],
            )

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return _bytes(docs, id_col, text_col).mapInArrow(scored, f"doc_id {dict(docs.dtypes)[id_col]}, {counts}, base_failed boolean, llr double, kept boolean")
