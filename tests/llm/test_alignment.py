"""Alignment against the libraries' ids and loops over all token pairs: nulls, unfaithful, empty and long texts, repeated rows, empty tables."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from umbra.llm import alignment, bytelevel

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "the", " the", "B", "é", "é", "漢", "🙂", "'s", "12", " ", "  ", "\n", "\x0b", " ", "\x1c", "\x85", "　", "İ", "<|endoftext|>", "<s>", "..", "\t"]


def _text(draw, most=40):
    return "".join(draw.choice(ALPHABET) for _ in range(draw.randrange(most)))


@pytest.fixture(scope="module")
def libraries():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def test_ids_equal_libraries(libraries):
    a, b = alignment.ByteLevel(A), alignment.WordPiece(B)
    draw = random.Random(3)
    texts = [_text(draw) for _ in range(500)] + ["a b▁c▁▁ d", " lead", "trail  ", "\n", "<0x0A>"]
    assert [x.tolist() for x in a.encode(texts)] == [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    wanted = [ids for t, ids in zip(texts, libraries[1].encode(texts)) if t]
    assert [x.tolist() for t, x in zip(texts, b.encode(texts)) if t] == wanted


def _brute(rows, libraries):
    shown = bytelevel.byte_characters()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        whole = (" " + text).encode()
        a = libraries[0].encode(" " + text, add_special_tokens=False).ids if text else []
        b = libraries[1].encode(text) if text else []
        bytes_a = [bytes(shown[c] for c in libraries[0].id_to_token(i)) for i in a]
        bytes_b = [bytes([int(libraries[1].id_to_piece(i)[3:5], 16)]) if libraries[1].is_byte(i) else libraries[1].id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a = b = bytes_a = bytes_b = []
        spans = []
        for tokens in (bytes_a, bytes_b):
            at, mine = 0, []
            for t in tokens:
                mine.append((at, at + len(t)))
                at += len(t)
            spans.append(mine)
        links = [(a[i], b[j]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, before = [], 0
        for cut in cuts:
            side = [",".join(str(t) for t, s in zip(ids, mine) if before < s[1] <= cut) for ids, mine in zip((a, b), spans)]
            groups.append("|".join(side))
            before = cut
        counts.update(set(links))
        docs.append((doc_id, len(a), len(b), len(cuts), links, ";".join(groups)))
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    return sorted(
        str((d, na, nb, ng, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if na else "", g))
        for d, na, nb, ng, links, g in docs
    )


def _rows():
    draw = random.Random(9)
    rows = [(i * 2, _text(draw)) for i in range(150)]
    rows += [(1, None), (3, ""), (5, "a▁b"), (7, "the cat " * 300), (9, "x" * 700), (None, rows[3][1]), (None, None), rows[8], rows[8]]
    return rows


@pytest.mark.parametrize(("parts", "slice_tokens", "block_docs"), [(1, 1 << 17, 1 << 16), (3, 7, 1 << 16), (2, 200, 20)])
def test_equals_all_pairs(spark, libraries, monkeypatch, parts, slice_tokens, block_docs):
    rows = _rows()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, block string, pair int").repartition(parts)
    # Workers take the sizes with the function that is sent to them.
    block = alignment.Block
    monkeypatch.setattr(alignment, "SLICE", slice_tokens)
    monkeypatch.setattr(alignment, "BLOCK_DOCS", block_docs)
    got = alignment.align_tokenizers(frame, A, B).collect()
    assert block is alignment.Block
    assert sorted(str(tuple(r)) for r in got) == _brute(rows, libraries)


def test_blocks_in_slices(libraries):
    """The same without Spark, so that the small slices are sure to be used."""
    import duckdb

    rows = _rows()
    for tokens in (1, 5, 64, 1 << 17):
        with pytest.MonkeyPatch.context() as patch, duckdb.connect(config={"threads": 1}) as db:
            patch.setattr(alignment, "SLICE", tokens)
            block = alignment.Block(db, alignment.ByteLevel(A), alignment.WordPiece(B), True)
            block.add([r[0] for r in rows], [r[1] for r in rows])
            columns, _, held = block.rows()
        brute = _brute(rows, libraries)
        mine = sorted(str(r) for r in zip(columns["doc_id"], columns["n_a"].tolist(), columns["n_links"].tolist(), columns["groups_sha256"], columns["groups"]))
        import ast

        kept = [ast.literal_eval(t) for t in brute]
        assert mine == sorted(str((t[0], t[1], t[4], t[7], t[8])) for t in kept)
        assert held.max() <= len(rows)


def test_empty_table_and_digest_only(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id int, text string")
    assert alignment.align_tokenizers(docs.limit(0), A, B).count() == 0
    got = {r.doc_id: r for r in alignment.align_tokenizers(docs, A, B, keep_groups=False).collect()}
    assert "groups" not in got[1] and got[1].n_best == got[1].n_links == got[1].count_sum > 0
    assert got[2].groups_sha256 == "" and got[2].n_links == got[2].count_sum == 0
