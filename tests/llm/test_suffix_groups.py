"""Many segments under one anchor: more texts than 16 bits number, and crowded anchors against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from umbra.llm import suffixes


def test_more_texts_than_sixteen_bits_number():
    draw = random.Random(4)
    texts = [bytes(draw.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(66_000)]
    seen = Counter(t[i : i + 5] for t in texts for i in range(3))
    got = suffixes.repeated_starts(texts, np.ones(len(texts), np.int64), window=5)
    assert [m.tolist() for m in got] == [[seen[t[i : i + 5]] > 1 for i in range(3)] for t in texts]


def test_one_passage_in_many_surroundings(spark, monkeypatch):
    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    line = word(260)
    rows = [(None if i == 3 else i, word(draw.randrange(5, 300)) + line + word(draw.randrange(5, 300))) for i in range(120)]
    rows += [rows[0], (200, rows[1][1]), (201, line), (202, line[:210]), (203, line[1:200]), (204, None)]
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t or "") - 199))
    want = Counter()
    for key, text in rows:
        gone = np.zeros(len(text or ""), bool)
        for i in range(len(gone) - 199):
            if seen[text[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want[key, int(gone.sum()), hashlib.sha256("".join(c for c, g in zip(text or "", gone) if not g).encode()).hexdigest()] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (0, 40, 1500):
        monkeypatch.setattr(suffixes, "CROWD", crowd)
        assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in suffixes.suffix_dedup(docs).collect()) == want
