"""The language model learns from every word of its training documents."""

import random

import pyarrow as pa

from umbra.llm import language


def test_each_word_lies_in_one_segment():
    random.seed(1)
    for _ in range(300):
        words = [bytes(random.choice(b"abcDE") for _ in range(random.choice([1, 3, 9, 40, 170, 400]))) for _ in range(random.randint(0, 60))]
        text = b"".join(w + random.choice([b" ", b" ", b"\n", b"\t", b"  "]) for w in words)
        found = language._segments(pa.array([text.decode()])[0])
        assert [w for segment in found for w in segment] == text.lower().split()
