"""Repeated passages where rows share an id or have none: nothing goes that does not repeat."""

import hashlib

import pytest
from pyspark.sql import functions as F

from umbra.llm.substrings import substring_dedup
from umbra.llm.suffixes import suffix_dedup


@pytest.fixture(scope="module")
def colliding(spark):
    """Two texts without a common passage that one 32-bit hash does not tell apart."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    parts = [F.sha2(F.concat(digest, F.lit(str(i))), 256) for i in range(8)]
    texts = spark.range(260_000).select(F.concat_ws(" ", *(F.substring(p, k, 5) for p in parts for k in range(1, 60, 5))).alias("text"))
    return texts.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").first()["texts"][:2]


@pytest.mark.parametrize("dedup", [suffix_dedup, substring_dedup])
def test_only_what_repeats_goes(spark, colliding, dedup):
    one, other = colliding
    rows = [(None, one), (None, other), (1, one), (7, other[:100]), (7, "short")]
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {hashlib.sha256(t.encode()).hexdigest() for t in (other, other[:100], "short")}
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in got) == [(0, False), (0, True), (1, True), (7, False), (7, False)]
    assert {r.kept_sha256 for r in got if not r.n_removed} == kept


@pytest.mark.parametrize("dedup", [suffix_dedup, substring_dedup])
def test_repeats_of_one_id_and_ids_of_text(spark, colliding, dedup):
    one, other = colliding
    rows = [("a", one), ("a", one), ("a", other), (None, "x"), ("b", None)]
    got = dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.n_removed > 0) for r in got) == [("", False), ("a", False), ("a", True), ("a", True), ("b", False)]
