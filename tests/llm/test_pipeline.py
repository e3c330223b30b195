"""The pipeline's stages on small tables against plain loops, with clashing columns, null ids and empty tables."""

import random
from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from umbra.llm import lines, simhash, toxicity

SF = "/root/testdata/sf0.001"
CLASHING = {"predicted": 7, "n_removed": 3, "times": 2, "copy": "c", "score": None, "kept_0": 1, "component_id": 9, "fp": 5, "own_1": "o", "size": 4}


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(6)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(random.choice(words) for _ in range(random.choice([5, 30, 90]))) for _ in range(30)]
    texts += [texts[0], texts[1] + " x", None, "", "a line that is long enough to be near\nb", "a line that is long enough to be nearr"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[2], "en", "s0", 1), (None, "only here " * 9, None, None, 2), (None, "only here " * 9, None, None, 2), rows[5]]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, value in CLASHING.items():
        made = made.withColumn(name, F.lit(value).cast("string") if value is None else F.lit(value))
    return made


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES[:-1]])
def test_stage_keeps_columns_and_takes_empty_tables(spark, docs, stage):
    found = stage(spark, docs, SF)
    assert found.columns == docs.columns
    for row in found.collect():
        assert all(row[k] == v for k, v in CLASHING.items())
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_equals_its_steps_by_hand(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in documents.collect()}
    judged = {r.doc_id: r.predicted for r in toxicity.score_toxicity(documents, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    first = cp.toxicity(spark, documents, SF)
    assert {r.doc_id for r in first.collect()} == {i for i, p in judged.items() if not p}

    second = cp.lines(spark, first, SF)
    texts = {r.doc_id: r.text for r in second.collect()}
    for r in lines.line_dedup(first).collect():
        gone = r.n_removed > 0 and not (r.text or "").strip()
        assert (r.doc_id not in texts) if gone else (texts[r.doc_id] == r.text)

    third = cp.near_duplicates(spark, second, SF)
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in texts.items()}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and root[j] < root[i]:
                    root[i], changed = root[j], True
    assert sorted(r.doc_id for r in third.collect()) == sorted(i for i in prints if root[i] == i)

    fourth = cp.mixing(spark, third, SF)
    copies = Counter(r.doc_id for r in fourth.collect())
    assert set(copies.values()) <= {1, 2}
    assert set(copies) <= {i for i in prints if root[i] == i} <= set(rows)
    assert {r.doc_id: r.text for r in fourth.collect()}.items() <= texts.items()
    assert cp.run(spark, SF).count() == sum(copies.values())


def test_rows_without_ids(spark, docs):
    kept = cp.near_duplicates(spark, docs, SF).where("doc_id IS NULL").collect()
    assert [r.text for r in kept] == ["only here " * 9]
    worded = cp.mixing(spark, docs.where("doc_id IS NULL"), SF).collect()
    assert worded and all(r.doc_id is None for r in worded)
