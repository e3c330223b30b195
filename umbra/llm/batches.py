"""Arrow batches in small pieces, so that what a worker makes of one stays small whatever the batch's size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that a piece holds at most, unless its only row has more.
MOST_BYTES = 1 << 21


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive rows of each batch, cut where ``column`` (text or binary) has ``most`` bytes; no row is left out."""
    for batch in batches:
        sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def small_batches(spark: SparkSession, most: int = 2 * MOST_BYTES) -> None:
    """Let Spark hand rows to Python in batches of ``most`` bytes; a session that asks for fewer keeps its number.

    Ten thousand texts, Spark's other bound, may be any number of bytes; many short rows still come in large batches.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("bB"))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))
