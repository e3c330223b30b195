"""Cross-tokenizer alignment: token intervals of two vocabularies joined in DuckDB by each task, pair counts merged in Spark."""

from __future__ import annotations

import hashlib
import json
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.batches import pieces, small_batches
from umbra.llm.bytelevel import byte_characters
from umbra.shared import stash

#: Bytes of text and documents whose pairs get numbers together, and tokens that one DuckDB query joins.
BLOCK_BYTES, BLOCK_DOCS, SLICE = 4 << 20, 1 << 16, 1 << 17
#: Words whose ids a worker remembers, and words encoded in one call.
MOST_WORDS, AT_ONCE = 500_000, 2000
DUCKDB_MEMORY = "400MB"

_SPACE = "▁"
#: The split of the first tokenizer, as its file names it and as the library knows it by that name (fixed values).
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """Ids of texts with a space before them, by a byte-level tokenizer file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        if settings["normalizer"] is not None or settings["pre_tokenizer"] != _BYTE_LEVEL:
            raise ValueError("the file must split texts at the usual byte-level pattern and change nothing in them")
        special = {t["id"] for t in settings["added_tokens"]}
        entries, characters = settings["model"]["vocab"], byte_characters()
        self.vocabulary = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.vocabulary[i] = entry.encode("utf-8") if i in special else bytes(characters[c] for c in entry)
        self.sizes = np.array([len(t) for t in self.vocabulary], np.int64)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in settings["model"]["merges"]]
        if [entries[m] for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("ids must be in order of the merges")
        ranks = {t: i for i, t in enumerate(self.vocabulary) if i not in special}
        self.encoder = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoder.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int32) for t in texts]


class WordPiece:
    """Ids of texts by a SentencePiece model that puts a space before them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE in name.lstrip(_SPACE) for name in names):
            raise ValueError("the model has pieces that run from one word into the next")
        self.vocabulary = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(_SPACE, " ").encode("utf-8") for i, n in enumerate(names)]
        self.sizes = np.array([len(t) for t in self.vocabulary], np.int64)
        self.known: dict[str, bytes] = {}

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        """No piece runs over a space, so in texts with single spaces between words each word is encoded once."""
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(words) > MOST_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            self.known.update(zip(some, [array("i", ids).tobytes() for ids in self.model.encode(some, num_threads=1)], strict=True))
        packed = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        own = sizes[codes]
        ends = np.cumsum(own)
        ids = np.frombuffer(b"".join(packed), "<i4")[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - own), own) + np.arange(ends[-1])]
        last = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
        return np.split(ids, ends[last - 1][:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if t and t[0] != " " != t[-1] and "  " not in t and _SPACE not in t]
        out: list = [None] * len(texts)
        for i, ids in zip(plain, self._words([texts[i] for i in plain]) if plain else (), strict=True):
            out[i] = ids
        return [np.array(self.model.encode(t), np.int32) if ids is None else ids for t, ids in zip(texts, out, strict=True)]


_tokenizers: dict[tuple[str, str], tuple[ByteLevel, WordPiece]] = {}


def tokenizers_of(path_a: str, path_b: str) -> tuple[ByteLevel, WordPiece]:
    """The worker's two tokenizers, built once."""
    if (path_a, path_b) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path_a, path_b] = ByteLevel(path_a), WordPiece(path_b)
    return _tokenizers[path_a, path_b]


#: Of two tokens that overlap, the one that begins later begins within the other. So an ASOF join gives each token of A the
#: token of B that it begins in, and a second one, with the token's end as upper bound, each token of B that begins inside one of A.
SPANS = """CREATE OR REPLACE TEMP TABLE spans AS
    SELECT a.seq, a.doc, a.id AS a, b.id AS b, b.seq AS first, a.lo = b.lo AS same FROM a ASOF JOIN b ON a.lo >= b.lo"""
INNER = "CREATE OR REPLACE TEMP TABLE inside AS SELECT b.doc, a.id AS a, b.id AS b FROM b ASOF JOIN a ON b.lo > a.lo WHERE b.lo < a.hi"
GROUPS = "SELECT seq, doc, first, same, sum(same::INT) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM spans"
PAIRS = "SELECT doc, a, b, count(*)::BIGINT AS links FROM (SELECT doc, a, b FROM spans UNION ALL SELECT doc, a, b FROM inside) GROUP BY ALL"


def spelt(ids_a: np.ndarray, ids_b: np.ndarray, groups: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The text ``a1,a2|b1;a3|b2`` of groups as bytes, and the places in it where each group begins.

    Every token is written with the sign before it, a group's first with a semicolon.
    """
    in_a = np.bincount(groups["grp"])[1:]
    in_b = np.diff(np.append(groups["first"][groups["same"]], len(ids_b)))
    ends_a, ends_b = np.cumsum(in_a), np.cumsum(in_b)
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    place_a = np.arange(len(ids_a)) + np.repeat(ends_b - in_b, in_a)
    place_b = np.arange(len(ids_b)) + np.repeat(ends_a, in_b)
    order[place_a], order[place_b] = ids_a, ids_b
    signs = np.full(len(order), ord(","), np.uint8)
    first = place_a[ends_a - in_a]
    signs[first], signs[place_b[ends_b - in_b]] = ord(";"), ord("|")
    digits = 1 + sum((order >= 10**k).astype(np.int64) for k in range(1, 10))
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - digits - 1] = signs
    for k in range(int(digits.max(initial=0))):
        more = digits > k
        out[ends[more] - 1 - k] = 48 + order[more] // 10**k % 10
    return out, (ends - digits - 1)[first]


class Block:
    """Documents of a task whose pairs get numbers together; all in bytes laid end to end, so offsets tell documents apart."""

    def __init__(self, db, a: ByteLevel, b: WordPiece, keep_groups: bool):
        self.db, self.a, self.b, self.keep = db, a, b, keep_groups
        self.ids: list = []
        self.bytes = 0
        self.a_ids: list[np.ndarray] = []
        self.b_ids: list[np.ndarray] = []

    def add(self, doc_ids: list, texts: list[str | None]) -> None:
        plain = [t or "" for t in texts]
        none = np.empty(0, np.int32)
        for text, a, b in zip(plain, self.a.encode(plain), self.b.encode(plain), strict=True):
            whole = (" " + text).encode("utf-8")
            right = text and all(b"".join(map(side.vocabulary.__getitem__, ids.tolist())) == whole for side, ids in ((self.a, a), (self.b, b)))
            self.a_ids.append(a if right else none)
            self.b_ids.append(b if right else none)
            self.bytes += len(whole)
        self.ids += doc_ids

    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or len(self.ids) >= BLOCK_DOCS

    def _slices(self, hi_a: np.ndarray, hi_b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Runs of tokens of both sides, cut where two tokens end together; a long text falls into several."""
        a = b = 0
        while a < len(hi_a):
            to = min(a + SLICE, len(hi_a)) - 1
            while True:
                other = int(np.searchsorted(hi_b, hi_a[to]))
                if other < len(hi_b) and hi_b[other] == hi_a[to]:
                    break
                to += 1
            yield a, to + 1, b, other + 1
            a, b = to + 1, other + 1

    def rows(self) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """Columns of the documents, and the block's pairs with the number of its documents that hold each."""
        n = len(self.ids)
        sizes_a, sizes_b = (np.array([len(x) for x in ids], np.int64) for ids in (self.a_ids, self.b_ids))
        ids_a, ids_b = (np.concatenate([*ids, np.empty(0, np.int32)]) for ids in (self.a_ids, self.b_ids))
        docs_a, docs_b = np.repeat(np.arange(n), sizes_a), np.repeat(np.arange(n), sizes_b)
        hi_a, hi_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])
        lo_a, lo_b = hi_a - self.a.sizes[ids_a], hi_b - self.b.sizes[ids_b]
        n_groups, digests, texts = np.zeros(n, np.int64), [hashlib.sha256() for _ in range(n)], [[] for _ in range(n)]
        found, last_doc = [], -1
        for a0, a1, b0, b1 in self._slices(hi_a, hi_b):
            for name, lo, hi, doc, ids, x, y in (("a", lo_a, hi_a, docs_a, ids_a, a0, a1), ("b", lo_b, hi_b, docs_b, ids_b, b0, b1)):
                table = {"seq": np.arange(y - x), "doc": doc[x:y], "id": ids[x:y], "lo": lo[x:y], "hi": hi[x:y]}
                self.db.register(name, pa.table(table))
            self.db.execute(SPANS)
            self.db.execute(INNER)
            groups = {k: np.asarray(v) for k, v in self.db.execute(GROUPS).fetchnumpy().items()}
            in_order = np.argsort(groups["seq"], kind="stable")
            groups = {k: v[in_order] for k, v in groups.items()}
            pairs = self.db.execute(PAIRS).fetchnumpy()
            found.append([np.asarray(pairs[k]).astype(np.int64) for k in ("doc", "a", "b", "links")])
            owners = groups["doc"][groups["same"]]
            n_groups += np.bincount(owners, minlength=n)
            text, begins = spelt(ids_a[a0:a1], ids_b[b0:b1], groups)
            here, at = np.unique(owners, return_index=True)
            ends = np.append(begins[at[1:]], len(text))
            for doc, begin, end in zip(here.tolist(), begins[at].tolist(), ends.tolist(), strict=True):
                part = text[begin + (doc != last_doc) : end].tobytes()
                digests[doc].update(part)
                if self.keep:
                    texts[doc].append(part)
                last_doc = doc
        doc, a, b, links = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 4
        width = len(self.a.vocabulary) * len(self.b.vocabulary)
        whole, back = np.unique(doc * width + a * len(self.b.vocabulary) + b, return_inverse=True)
        links = np.bincount(back, links).astype(np.int64)
        doc, (pairs, index) = whole // width, np.unique(whole % width, return_inverse=True)
        bounds = np.searchsorted(doc, np.arange(n + 1))
        most = np.where(links < 255, links, 255).astype(np.uint8)
        columns = {
            "doc_id": self.ids, "n_a": sizes_a, "n_b": sizes_b, "n_groups": n_groups, "n_links": np.bincount(doc, links, n).astype(np.int64),
            "groups_sha256": [d.hexdigest() if s else "" for d, s in zip(digests, sizes_a)],
            "pair_index": [index[x:y].astype("<u4").tobytes() for x, y in zip(bounds, bounds[1:])],
            "pair_links": [most[x:y].tobytes() for x, y in zip(bounds, bounds[1:])],
            "more_links": [(links[x:y] - most[x:y])[most[x:y] == 255].astype("<u4").tobytes() for x, y in zip(bounds, bounds[1:])],
            "groups": [b"".join(t).decode() if self.keep else None for t in texts],
        }
        return columns, pairs, np.bincount(index, minlength=len(pairs))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, keep_groups: bool) -> DataFrame:
    """Rows of documents (``pair`` is null) and of the pairs of each block: block, pair, a, b, docs; see ``align_tokenizers``."""
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    long = pa.int64()

    def sent(block: Block, number: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        columns, pairs, held = block.rows()
        n, m, width = len(block.ids), len(pairs), len(block.b.vocabulary)
        kinds = [kind, long, long, long, long, pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
        names = ["block", *columns, "pair", "a", "b", "docs"]
        for x in range(0, n, 2048):
            y = min(x + 2048, n)
            own = [pa.array(v[x:y], k) for v, k in zip(columns.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(y - x, number)), *own, *[pa.nulls(y - x, long)] * 4], names=names)
        for x in range(0, m, 1 << 16):
            y = min(x + (1 << 16), m)
            own = [pa.array(v, long) for v in (np.arange(x, y), pairs[x:y] // width, pairs[x:y] % width, held[x:y])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(y - x, number)), *[pa.nulls(y - x, k) for k in kinds], *own], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        a, b = tokenizers_of(path_a, path_b)
        kind, number = pa.null(), TaskContext.get().partitionId() << 32
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": spill}) as db:
            block = Block(db, a, b, keep_groups)
            for batch in pieces(batches, 1):
                kind = batch.schema.field(0).type
                block.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                if block.full():
                    yield from sent(block, number, kind)
                    block, number = Block(db, a, b, keep_groups), number + 1
            if block.ids:
                yield from sent(block, number, kind)

    schema = f"""block long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair_index binary,
        pair_links binary, more_links binary, groups string, pair long, a long, b long, docs long"""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(read, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count, best of blocks' pairs (a, b, docs): documents that hold the pair linked, and whether no pair of ``a`` has more."""
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    tops = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(tops, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with ``keep_groups``, groups.

    ``path_a`` is a byte-level tokenizer file, used on the text with a space before it, ``path_b`` a SentencePiece model that puts one
    before it itself; special tokens' strings are plain text. Tokens are byte intervals; two are linked if they overlap, and both sides fall into
    groups wherever two tokens end together. A pair of ids counts as many documents as hold it linked. n_best are links whose pair no other pair of
    its ``a`` exceeds, count_sum adds the counts up over links. ``groups`` is the text ``a1,a2|b1;a3|b2``.

    Each task lays the tokens of some megabytes of text end to end and joins the two interval tables in DuckDB: each token of one side
    with the token of the other that it begins in. It numbers the
    different pairs of a block, so documents carry numbers and a block sends each pair once. The counts come back
    by block; a block's documents and pairs are bounded by BLOCK_BYTES and its longest text.

    Null, empty and not faithfully spelt texts have no tokens: zeros and ''. Rows repeated with one id are documents of
    their own and count as such. An empty table gives an empty result. Further columns are ignored.
    """
    whole = stash(aligned(docs, path_a, path_b, id_col, text_col, keep_groups), "aligned")
    pairs = whole.where("pair IS NOT NULL").select("block", "pair", "a", "b", "docs")
    marks = pairs.join(pair_counts(pairs), ["a", "b"]).select(F.col("block").alias("block_of"), "pair", "count", "best")
    shown = ["groups_sha256", "groups"] if keep_groups else ["groups_sha256"]
    texts = whole.where("pair IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", *shown, "pair_index", "pair_links", "more_links")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *shown]

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right.column("pair").to_numpy()
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy()
        sums, bests = [], []
        for index, links, more in zip(*(left.column(c).to_pylist() for c in ("pair_index", "pair_links", "more_links")), strict=True):
            where, n = np.frombuffer(index, "<u4"), np.frombuffer(links, np.uint8).astype(np.int64)
            n[n == 255] += np.frombuffer(more, "<u4")
            sums.append(int(count[where] @ n))
            bests.append(int(best[where] @ n))
        return left.select(names).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "n_best bigint", "count_sum bigint"])
    found = texts.groupBy("block").cogroup(marks.groupBy("block_of")).applyInArrow(summed, schema)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *shown)
