"""Packing against the library's ids and a plain dynamic program: nulls, empty and very long texts, ties, repeated rows, empty tables."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from umbra.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def _least(where, costs, length):
    """Cost of the cheapest cuts at all pairs of places."""
    best = {0: 0.0}
    for p, own in zip(where, costs):
        best[p] = own + min(best[q] + (0 if (p - q) & (p - q - 1) == 0 else length - (p - q)) for q in best if 0 < p - q <= length)
    return best[where[-1]]


def _paid(cuts, where, costs, length):
    own = dict(zip(where, costs))
    sizes = np.diff([0, *cuts])
    assert sizes.min() > 0 and sizes.max() <= length
    return sum(own[c] for c in cuts) + sum(0 if n & (n - 1) == 0 else length - n for n in sizes.tolist())


@pytest.mark.parametrize("seed", range(8))
def test_cuts_cost_as_little_as_plain_program(seed):
    draw = random.Random(seed)
    length = draw.choice([8, 16, 24, 64])
    where, at = [], 0
    for _ in range(400):
        at += draw.randrange(1, draw.choice([2, length // 2, length + 1]))
        where.append(at)
    costs = [draw.choice([0.0, 0.0, 4.0, 32.0]) for _ in where]
    cutter, cuts = packing.Cutter(length), []
    for i in range(0, len(where), 37):
        cutter.extend(np.array(where[i : i + 37]), np.array(costs[i : i + 37]))
        cuts += cutter.settled()
    cuts += cutter.close()
    assert cuts[-1] == where[-1] and cuts == sorted(set(cuts))
    assert _paid(cuts, where, costs, length) == _least(where, costs, length)


def test_words_equal_library():
    tokenizer, words = Tokenizer.from_file(PATH), packing.Words(PATH)
    draw = random.Random(4)
    alphabet = ["a", "B", "é", "é", "Σ", "ß", "漢", "🙂", "'s", "don't", "9", " ", "\n", "\x0b", " ", "\x1c", "́", "İ", "<|endoftext|>", "..", "\t  ", "I'LL", "x.y", "<|"]
    for _ in range(400):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(40)))
        assert words.encode(pa.array([text]), 1)[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_words_of_a_table_equal_library():
    """Ranks give the library's ids for every word of the documents and for words of few letters, whose merges compete."""
    import pyarrow.parquet as pq

    tokenizer, words, draw = Tokenizer.from_file(PATH), packing.Words(PATH), random.Random(6)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts += [" ".join("".join(draw.choices("aeistnéßаб漢.,-"[: draw.choice([3, 7, 15])], k=draw.randrange(1, 16))) for _ in range(2000))]
    ids, sizes, _ = words.encode(pa.array(texts), 1)
    want = [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_sentences_of_texts():
    words = packing.Words(PATH)
    texts = [" One two.\n Three (four!)\t3.14 five? ", None, "End.", "no stop", ""]
    ids, sizes, sentences = words.encode(pa.array(texts), 1)
    whole = [[*Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == sum(whole, []) and sizes.tolist() == [len(t) for t in whole]
    firsts = [len(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids) for t in ("One two.", "One two. Three (four!)", "One two. Three (four!) 3.14 five?", "End.")]
    assert sentences.tolist() == [*firsts[:3], len(whole[0]) + len(whole[1]) + firsts[3]]
    where, cost = packing.places(np.array([3, 200]), np.array([5, 300]))
    assert dict(zip(where.tolist(), cost.tolist())) == {3: 4.0, 5: 0.0, 69: 32.0, 133: 32.0, 197: 32.0, 200: 4.0, 264: 32.0, 305: 0.0}


def _rows():
    draw = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["żółć.", "End.", "what?", "(so!)", "..."]
    texts = [" ".join(draw.choices(words, k=draw.choice([0, 1, 5, 60, 300, 1500]))) for _ in range(60)]
    texts += ["", None, " \n ", "x" * 5000, "nostop " * 9000, texts[5], texts[5]]
    rows = [(i * 3, t, "clash", i) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, texts[9], None, None), (None, None, None, None)]


SCHEMA = "doc_id long, text string, ids string, start int"


def test_pieces_hold_every_id_once(spark):
    tokenizer, rows = Tokenizer.from_file(PATH), _rows()
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    want = sorted(str([r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]]) for r in rows)
    in_sequence, whole, at = {}, [], None
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == in_sequence.get(r.sequence_id, 0) and r.length * 4 == len(r.ids)
        in_sequence[r.sequence_id] = r.offset + r.length
        # Within a task pieces of a document follow each other.
        if r.start == 0:
            at = [r.doc_id, []]
            whole.append(at)
        assert r.start == len(at[1]) and r.doc_id == at[0]
        at[1].extend(np.frombuffer(r.ids, "<u4").tolist())
        assert len(at[1]) <= r.doc_tokens
    assert sorted(map(str, whole)) == want
    sizes = list(in_sequence.values())
    assert max(sizes) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding < 0.01 * sum(sizes)


def test_same_rows_again_and_empty_table(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA).coalesce(2)
    first, again = (sorted(map(str, packing.pack_documents(docs, PATH).drop("ids").collect())) for _ in range(2))
    assert first == again
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
    assert packing.pack_documents(spark.createDataFrame([(1, None)], "doc_id int, text string").coalesce(1), PATH).collect()[0].asDict() == {
        "doc_id": 1, "start": 0, "length": 1, "doc_tokens": 1, "sequence_id": 0, "offset": 0, "ids": b"\x01\0\0\0"
    }


def test_settled_pieces_of_a_long_stream(monkeypatch):
    monkeypatch.setattr(packing, "SETTLE", 50)
    draw, packer, found, docs = random.Random(1), packing.Packer(64), [], []
    for d in range(500):
        ids = np.arange(draw.randrange(1, 150), dtype=np.uint32)
        docs.append(len(ids))
        packer.add([d], ids, np.array([len(ids)]), np.array(sorted(draw.sample(range(len(ids) + 1), min(len(ids), 4)))))
        if packer.ready():
            found.append(packer.settled())
    assert len(packer.doc_ids) < 100
    found.append(packer.close())
    rows = [(d, s, n) for f in found if f for d, s, n in zip(f["doc_id"], f["start"], f["length"])]
    for d, size in enumerate(docs):
        mine = [r for r in rows if r[0] == d]
        assert [r[1] for r in mine] == np.cumsum([0, *(r[2] for r in mine)])[:-1].tolist() and sum(r[2] for r in mine) == size


def test_sequences_are_padded(spark):
    packed = packing.pack_documents(spark.createDataFrame(_rows(), SCHEMA), PATH)
    for r in packing.sequences(packed).collect():
        n = r.n_tokens
        assert len(r.ids) == 4 * (n if n & (n - 1) == 0 else 2048) and 0 not in np.frombuffer(r.ids, "<u4")[:n]
