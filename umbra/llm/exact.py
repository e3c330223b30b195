"""Exact deduplication [native]: 128-bit content hash, smallest id stays, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.words import normalised


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by the MD5 of their normalised form *and* the normalised bytes, so two texts that collide
    in the hash still form two groups. The grouping combines inside each map task, so a group that holds a third
    of all rows reaches the shuffle as one row per task. Documents find their group over (MD5, SHA-256); only ids
    and digests move there, and adaptive execution may split that join where a group is large.

    Null text counts as empty; empty texts form one group. Null ids sort last (keep_id is null only if every id
    of the group is). Repeated rows with one id are the same document and stay or go together. An empty table
    gives an empty result. Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    hashed = rows.withColumn("md5", F.unhex(F.md5("body")))
    groups = (
        hashed.groupBy("md5", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("md5", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    )
    members = hashed.select("doc_id", "md5", F.unhex(F.sha2("body", 256)).alias("sha"))
    return members.join(groups, ["md5", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
