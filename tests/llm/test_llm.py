"""Small cases of the corpus operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from umbra.llm import bpe, exact, lines, mixing, quality, queries, simhash, substrings, suffixes, toxicity

PATH = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(400)] + ["żółć", "naïve", "!!"]
    texts = [" ".join(random.choice(words) for _ in range(random.choice([0, 1, 3, 40, 120]))) for _ in range(40)]
    texts += [texts[5], texts[9] + " tail", "a  b\tc", "a b c", "", None, "ab" * 30000, "ab" * 30000]
    rows = [(i * 3, t, "en", None if i % 7 == 0 else f"s{i % 4}", "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[3], None, "s1", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, body string, weight int")


OPERATORS = {
    "bpe": lambda d: bpe.encode_documents(d, PATH, public_tokenizers.PATTERN),
    "exact": exact.exact_dedup,
    "mixing": mixing.mix_sources,
    "lines": lines.line_dedup,
    "simhash": simhash.simhash_components,
    "substrings": substrings.substring_dedup,
    "suffixes": suffixes.suffix_dedup,
    "quality": lambda d: quality.quality_rules(d, d.where("doc_id < 30").select("doc_id")),
    "toxicity": lambda d: toxicity.score_toxicity(d, d.select("doc_id", F.lit(0).alias("toxic"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back_and_empty_tables_stay_empty(docs, name):
    assert OPERATORS[name](docs).count() == docs.count()
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_transducer_equals_library():
    import tiktoken

    ranks = bpe.read_ranks(PATH)
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    random.seed(1)
    for _ in range(300):
        text = "".join(random.choice("aeinrst  THéß漢字🙂\n0129,.'") for _ in range(random.randrange(60)))
        ids = codec.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert "".join(codec.decode(ids, chunk=1)) == text


def _windows(rows, size, split):
    seen = Counter(tuple(s[i : i + size]) for _, t in rows for s in [split(t or "")] for i in range(len(s) - size + 1))
    for key, text in rows:
        s = split(text or "")
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - size + 1):
            if seen[tuple(s[i : i + size])] > 1:
                gone[i : i + size] = True
        yield key, s, gone


def test_passages_equal_brute_force(docs):
    short = docs.where("coalesce(length(text), 0) < 5000")
    rows = [(r.doc_id, r.text) for r in short.collect()]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(short).collect())
    want = Counter((k, len(s), int(g.sum()), hashlib.sha256(b" ".join(w for w, x in zip(s, g) if not x)).hexdigest()) for k, s, g in _windows(rows, 35, lambda t: t.encode().split()))
    assert got == want
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.suffix_dedup(short).collect())
    want = Counter((k, len(s), int(g.sum()), hashlib.sha256(bytes(w for w, x in zip(s, g) if not x)).hexdigest()) for k, s, g in _windows(rows, 200, lambda t: t.encode()))
    assert got == want


def test_long_repeats_go_as_a_whole(docs):
    long = suffixes.suffix_dedup(docs).where("n_bytes = 60000").collect()
    assert [(r.n_removed, r.n_spans) for r in long] == [(60000, 1)] * 2


def test_crowded_anchors_take_the_other_way(docs, monkeypatch):
    short = docs.where("coalesce(length(text), 0) < 5000")
    key = lambda df: sorted(map(str, df.collect()))
    want = key(substrings.substring_dedup(short)), key(suffixes.suffix_dedup(short))
    monkeypatch.setattr(substrings, "CROWD", 0)
    monkeypatch.setattr(suffixes, "CROWD", 0)
    assert (key(substrings.substring_dedup(short)), key(suffixes.suffix_dedup(short))) == want


def test_lines_within_one_edit_of_an_earlier_line_go(spark):
    a = "the quick brown fox jumps over the lazy dog"
    texts = [a, a[:5] + a[6:], "\n" + a + "!\nshort\n\nshort", a.replace("fox", "cat"), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.line_dedup(df).collect()}
    assert got == {0: a, 1: "", 2: "\nshort\n", 3: a.replace("fox", "cat"), 4: None}


def test_components_equal_brute_force(docs):
    rows = simhash.simhash_components(docs.where("doc_id IS NOT NULL")).collect()
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in rows}
    parent = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and parent[j] < parent[i]:
                    parent[i], changed = parent[j], True
    assert {r.doc_id: r.component_id for r in rows} == parent


def test_no_chain_is_missed():
    random.seed(9)
    for _ in range(2000):
        apart = np.uint64(sum(1 << b for b in random.sample(range(64), random.randrange(4))))
        assert ((apart & simhash.MASKS) == 0).any()


def test_mix_is_near_target_and_repeatable(docs):
    rows = mixing.mix_sources(docs, block_words=8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs, block_words=8).collect()))
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8 * (1 + len({r.shard for r in own}))


def test_exact_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES["op8_exact_dedup"])
    got = queries.QUERIES["op8_exact_dedup"](spark, SF).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_language_base_scores(spark):
    import math
    import zlib

    texts = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in queries.QUERIES["op7_language_model"](spark, SF).collect():
        own = texts[r.doc_id]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(own), n, sum(counts[w] > 0 for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert r.score < 0
