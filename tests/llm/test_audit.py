"""The filter audit against plain loops: null ids, texts and parts, repeated rows and labels, clashing columns, empty tables."""

import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from umbra.llm import audit

DOCS = "doc_id long, text string, lang string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def _fails(rows):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", text)), "E": text in first and doc_id != first[text]}
        yield doc_id, lang or "", {f for f, failed in fails.items() if failed}


def _brute(rows, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[i] == 1} for i in (1, 2))
    parts, out = {}, {}
    for doc_id, part, fails in _fails(rows):
        parts.setdefault(part, []).append((doc_id, fails))
    orders = ["".join(o) for o in permutations("ABCDE")]
    for part, found in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = found
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(gone)
                redundant = sum(f in r[1] for r in found) - len(gone)
                alone = sum(r[1] == {f} for r in found)
                out[part, order, step] = [len(left), len(gone), redundant, alone, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for order in orders:
            for step, f in enumerate(order, 1):
                out[part, order, step].append(removed_by[f])
    return out


def _rows():
    draw = np.random.default_rng(5)
    words = ["alpha", "beta", "Gamma", "DELTA", "e#f", "żółć", "x", "12"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choice(words[: int(draw.choice([9, 300]))], int(draw.choice([0, 5, 99, 100, 160])))) for _ in range(90)]
    texts += [texts[3]] * 4 + [texts[7], "", None, "A" * 10 + "b" * 90, "A" * 11 + "b" * 89, "ab " * 40000, "a\x0bb\x0cc\x1fd e " * 30]
    rows = [(i * 2 % 71, t, [None, "", "en", "pl", "de"][i % 5]) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[12], (None, texts[3], "en"), (None, "only without id", "en"), (None, "only without id", "pl")]


def test_equals_plain_loops(spark):
    rows = _rows()
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 70, 2)] + [(4, 1, 0), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], DOCS).repartition(5)
    got = audit.filter_audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == _brute(rows, labels)
    assert len(got) == 4 * 600


def test_empty_table_and_no_labels(spark):
    docs, labels = spark.createDataFrame(_rows(), "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    assert audit.filter_audit(docs, labels).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_many_parts_in_one_batch_and_parts_of_whole_words(spark):
    rows = [(f"p{i % 130}", i * 37 % 32, i % 2 == 0, i % 3 == 0) for i in range(64 * 130)]
    frame = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean").coalesce(1)
    got = audit.prefix_counts(frame).where("prefix = 5 AND filter = 3").collect()
    assert len(got) == 130
    for r in got:
        mine = [x for x in rows if x[0] == r.part and not x[1] & 5]
        assert (r.alive, r.removed, r.good_lost) == (len(mine), sum(x[1] >> 3 & 1 for x in mine), sum(x[1] >> 3 & 1 and x[2] for x in mine))
