"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that is sent to every task at most.
MOST_SENT = 64 << 20
#: Rows that a task sorts or groups, about, where a stash is told how many there are.
ROWS_A_TASK = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own where that is unset on a single machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='umbra-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _parts(spark: SparkSession, rows: int) -> dict[str, str]:
    """Settings with which so many rows are read and shuffled in tasks of about ``ROWS_A_TASK``, unless there are more tasks anyway."""
    tasks = -(-rows // ROWS_A_TASK)
    if tasks <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return {}
    return {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "32m"}


def stash(df: DataFrame, tag: str, rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cached table, the copy survives the loss of executors; unlike a row checkpoint it is columnar,
    compressed and pruned when read. Shuffle files behind it go as soon as it is written, the copy itself when the
    application ends. Where the number of ``rows`` that go through the plan is given, its shuffles have as many tasks as
    these need, so that no task's memory grows with them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _set(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | _parts(spark, rows)):
        df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def within(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``most`` bytes; otherwise as it is, to be joined by a shuffle."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    width = sum(wide, F.lit(16 * len(df.columns)))
    total = df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= most else df
