"""Corpus preparation: five stages over ``documents``, each written and read again between.

Every stage takes any further columns with whatever names and returns them untouched; null, empty and repeated rows
are told in each stage's docstring. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.bpe import encode_documents
from umbra.llm.lines import line_dedup
from umbra.llm.mixing import mix_sources
from umbra.llm.simhash import fingerprints, simhash_components
from umbra.llm.toxicity import score_toxicity
from umbra.shared import stash, within


def _set_apart(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list[str], list[Column]]:
    """``docs`` with all but the used columns under names of ours, these names, and the columns as they were."""
    others = [c for c in docs.columns if c not in used]
    ours = {c: f"own_{i}" for i, c in enumerate(others)}
    quoted = lambda c: F.col(f"`{c}`")
    plain = docs.select(*used, *(quoted(c).alias(ours[c]) for c in others))
    return plain, list(ours.values()), [F.col(ours[c]).alias(c) if c in ours else F.col(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Null and empty texts stay; repeated rows are judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, others, back = _set_apart(docs, ("doc_id", "text"))
    return score_toxicity(plain, labels, keep=["text", *others]).where("predicted = 0").select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document of which nothing is left goes, one that was blank before stays.

    n_chars, where there is such a column, follows the text. Rows repeated with one id and text lose the same lines.
    """
    plain, others, back = _set_apart(docs, ("doc_id", "text"))
    found = line_dedup(plain, keep=others)
    left = found.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) != "")).select(*back)
    return left.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id.

    Rows repeated with one id are one document and stay or go together. A row without an id goes if its fingerprint
    belongs to a group with an id; of rows without ids and with one fingerprint, one stays.
    """
    plain, _, back = _set_apart(docs, ("doc_id", "text"))
    found = stash(simhash_components(plain.select("doc_id", "text")), "near")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    named = plain.where("doc_id IS NOT NULL").join(within(gone), "doc_id", "left_anti").select(*plain.columns)
    held = found.where("component_id IS NOT NULL").select("fp").distinct()
    # Rows without ids carry a digest of themselves through the fingerprinting in place of an id.
    nameless = plain.where("doc_id IS NULL").withColumn("text_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    prints = fingerprints(nameless.groupBy("text_digest").agg(F.first("text").alias("text")), "text_digest")
    prints = prints.join(held, "fp", "left_anti").groupBy("fp").agg(F.min("doc_id").alias("text_digest")).select("text_digest")
    single = nameless.join(prints, "text_digest", "left_semi").dropDuplicates(["text_digest"]).select(*plain.columns)
    return named.unionByName(single).select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number: never, once or twice.

    Documents without words give the mix nothing and go. Rows with one id, or without one, come equally often.
    """
    plain, _, back = _set_apart(docs, ("doc_id", "text", "source"))
    mix = mix_sources(plain).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = stash(mix.where("size > 0").select("doc_id", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")), "times")
    nameless = times.where("doc_id IS NULL").first()
    worded = plain.where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D]", " ")) != "")
    taken = worded.join(times.where("times > 0").hint("shuffle_hash"), "doc_id")
    free = worded.where("doc_id IS NULL").withColumn("times", F.lit(nameless["times"] if nameless else 0))
    both = taken.unionByName(free.where("times > 0"))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*back)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digests of the ids and of the decoded text; null text has no ids."""
    return encode_documents(docs, str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing", mixing),
    ("bpe encoding", encoding),
]

#: SQL can't express the classifier, the fingerprints or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``; each result but the last is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stash(docs, f"stage-{number}")
    return docs
