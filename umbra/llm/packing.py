"""Packing: documents in order into sequences of a fixed length, cut where dynamic programming finds it cheapest."""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.batches import pieces, small_batches
from umbra.llm.bytelevel import byte_characters

#: Tokens that a cut costs at the end of a sentence and within one; at the end of a document it is free.
SENTENCE_COST, INNER_COST = 4.0, 32.0
#: Within a longer sentence there is a place to cut after every so many tokens.
STRIDE = 64
#: Places to cut after which settled sequences are handed on, and after which they are even if paths still differ.
SETTLE, MOST_PLACES = 1 << 16, 1 << 22
#: Words whose ids a worker remembers, and words encoded in one call.
MOST_WORDS, AT_ONCE = 500_000, 2000

#: The split of the tokenizer file that Words does itself (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space below U+0250 that does not separate words here.
_OTHER_SPACE = re.compile("[\x85\xa0]")
#: Stands for the end of a word; no UTF-8 text has this byte.
_END = b"\xff"


@cache
def _parts() -> Callable[[str], list[str]]:
    import regex

    return regex.compile(_PATTERN).findall


_CLOSERS = "\"')]}*_"
_STOPS = (".", "!", "?", "…", "。", "！", "？", "”", "»")
_LAST = {*_CLOSERS, *_STOPS}


def _by_rank(model: dict) -> tuple:
    """A rank encoder for a vocabulary with word ends, and the ids of its ranks.

    Ranks are in order of the merges, so the lowest rank among neighbours is the first merge; before all of them the
    last byte of a word takes up its end. Every token must come from one merge.
    """
    import tiktoken

    characters, vocabulary = byte_characters(), model["vocab"]

    def raw(token: str) -> bytes:
        end = token.endswith("</w>")
        return bytes(characters[c] for c in (token[:-4] if end else token)) + _END * end

    shown = {b: c for c, b in characters.items()}
    tokens = [shown[b] for b in range(256)] + [shown[b] + "</w>" for b in range(255)]
    tokens += ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranks = {raw(token): rank for rank, token in enumerate(tokens)}
    if len(ranks) != len(tokens):
        raise ValueError("two merges of the tokenizer make one token")
    ids = np.array([vocabulary[token] for token in tokens], "<u4")
    return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={}), ids


class Words:
    """Ids of white-space separated words; such words never share a token, so each is encoded once.

    A word is normalised and split as the tokenizer does it, and each part goes through its merges once. Words of
    characters below U+0250, composed ones all, skip the library's normaliser, which has nothing to do but lower them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        kinds = [n["type"] for n in (settings["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex", p["type"]) for p in (settings["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and splits == [_PATTERN, "ByteLevel"]
        self.special = [t["content"] for t in settings["added_tokens"]]
        self.marks = {t[0] for t in self.special}
        if self.plain:
            self.rank_encoder, self.rank_ids = _by_rank(settings["model"])
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.final: set[str] = set()

    def _part(self, part: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(part)]).tobytes()

    def _merged(self, part: str) -> bytes:
        """Ids of a part of a word by ranks; the library's own merges take thrice the time for the same ids."""
        ranks = self.rank_encoder._encode_single_piece(part.encode("utf-8") + _END)
        self.parts[part] = packed = self.rank_ids[ranks].tobytes()
        return packed

    def _others(self, words: list[str]) -> list[bytes]:
        """Ids of words through the library's normaliser and splitter, many in one call."""
        normaliser, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normaliser.normalize_str(" ".join(words))
        normal = text.split(" ")
        if len(normal) != len(words):
            # A word has white space of another kind, which the normaliser makes a plain one.
            return [array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in words]
        ends = np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)) + 1)
        split = splitter.pre_tokenize_str(text)
        owner = np.searchsorted(ends, np.fromiter((at for _, (at, _) in split), np.int64, len(split)), side="right")
        bounds = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        packed = [self._part(p) for p, _ in split]
        return [b"".join(packed[x:y]) for x, y in zip(bounds, bounds[1:])]

    def learn(self, words: list[str]) -> None:
        """Take up different words; ``known`` has all of them afterwards."""
        if len(self.known) + len(words) > MOST_WORDS:
            self.known.clear()
            self.parts.clear()
            self.final.clear()
        others, known, parts_of, get, make = [], self.known, _parts(), self.parts.get, self._merged
        for word in words:
            if word in known:
                continue
            if not self.marks.isdisjoint(word) and any(t in word for t in self.special):
                known[word] = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            elif self.plain and max(word, default="") < "\u0250" and not _OTHER_SPACE.search(word):
                known[word] = b"".join([get(p) or make(p) for p in parts_of(word.lower())])
            else:
                others.append(word)
            if word[-1:] in _LAST and word.rstrip(_CLOSERS).endswith(_STOPS):
                self.final.add(word)
        for at in range(0, len(others), AT_ONCE):
            some = others[at : at + AT_ONCE]
            self.known.update(zip(some, self._others(some), strict=True))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts, ``end_id`` after each; number of ids of each text; numbers of ids up to each end of a sentence."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(words)
        packed = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        final = np.fromiter(map(self.final.__contains__, words), bool, len(words))
        own = sizes[codes]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(b"".join(packed), "<u4")[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - own), own) + np.arange(total)]
        last = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        whole = np.append(0, ends)[last]
        stops = np.flatnonzero(final[codes])
        return np.insert(ids, whole, end_id), np.diff(np.append(0, whole)) + 1, ends[stops] + np.searchsorted(last, stops, side="right")


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The worker's words, one tokenizer at a time."""
    if path not in _words:
        _words.clear()
        _words[path] = Words(path)
    return _words[path]


def places(sentences: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where documents of ``sizes`` ids may be cut, and at what cost: sentence ends, long sentences in strides, their ends."""
    ends = np.cumsum(sizes)
    where = np.union1d(sentences, ends)
    where = where[where > 0]
    cost = np.full(len(where), SENTENCE_COST)
    cost[np.searchsorted(where, ends)] = 0.0
    gaps = np.diff(np.append(0, where))
    more = (gaps - 1) // STRIDE
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    extra = np.repeat(where - gaps, more) + nth * STRIDE
    order = np.argsort(whole := np.concatenate([where, extra]), kind="stable")
    return whole[order], np.concatenate([cost, np.full(len(extra), INNER_COST)])[order]


class Cutter:
    """Cheapest cuts of a stream of places into sequences of ``length`` at most: padding plus the costs of the cuts.

    cost(p) = place's cost + min over earlier cuts q of cost(q) + padding(p - q), where padding(n) is 0 for a power of two and
    length - n otherwise. The second kind is a minimum of cost(q) + q over the window, so a queue with
    increasing values has it in front; the first kind looks at one place per power.
    """

    def __init__(self, length: int):
        self.length = length
        self.powers = np.array([1 << k for k in range(length.bit_length()) if 1 << k <= length])
        self.where, self.cost, self.back = [0], [0.0], [-1]
        self.queue = deque([0])

    def _partners(self, where: np.ndarray) -> tuple[list[int], list[int]]:
        """How many places lie a power of two before each new one, and these places' numbers one after the other."""
        known = len(self.where)
        first = known - 1
        while first and self.where[first - 1] >= where[0] - self.length:
            first -= 1
        whole = np.concatenate([np.array(self.where[first:]), where])
        number = np.full(int(whole[-1] - whole[0]) + 1, -1, np.int64)
        number[whole - whole[0]] = np.arange(first, first + len(whole))
        before = where[:, None] - self.powers - whole[0]
        found = np.where(before >= 0, number[np.maximum(before, 0)], -1)
        met = found >= 0
        return met.sum(axis=1).tolist(), found[met].tolist()

    def extend(self, where: np.ndarray, costs: np.ndarray) -> None:
        if not len(where):
            return
        length, queue = self.length, self.queue
        all_where, all_cost, all_back = self.where, self.cost, self.back
        counts, partners = self._partners(where)
        at, k = 0, len(all_where)
        for p, own, count in zip(where.tolist(), costs.tolist(), counts, strict=True):
            while all_where[queue[0]] < p - length:
                queue.popleft()
            come = queue[0]
            best = all_cost[come] + length - (p - all_where[come])
            if count:
                for i in partners[at : at + count]:
                    if all_cost[i] < best:
                        best, come = all_cost[i], i
                at += count
            best += own
            all_where.append(p)
            all_cost.append(best)
            all_back.append(come)
            value = best + p
            while queue and all_cost[queue[-1]] + all_where[queue[-1]] >= value:
                queue.pop()
            queue.append(k)
            k += 1

    def _path(self, k: int) -> list[int]:
        found = []
        while k > 0:
            found.append(self.where[k])
            k = self.back[k]
        return found[::-1]

    def settled(self) -> list[int]:
        """Cuts that every path to a live place shares, at most up to their last one; these are dropped here."""
        reach = self.where[-1] - self.length
        live, k = [], len(self.where) - 1
        while k > 0 and self.where[k] >= reach:
            live.append(-k)
            k -= 1
        if len(self.where) > MOST_PLACES:
            live = [-min((-i for i in live), key=lambda i: self.cost[i])]
        live = sorted(set(live))
        while len(live) > 1:
            before = self.back[-heapq.heappop(live)]
            while live and -live[0] == before:
                heapq.heappop(live)
            heapq.heappush(live, -before)
        return self._drop(-live[0]) if live else []

    def _drop(self, k: int) -> list[int]:
        found = self._path(k)
        if k <= 0:
            return found
        self.where, self.cost = self.where[k:], self.cost[k:]
        self.back = [-1] + [b - k for b in self.back[k + 1 :]]
        self.queue = deque(i - k for i in self.queue if i >= k) or deque([0])
        return found

    def close(self) -> list[int]:
        """The cheapest cuts up to the last place."""
        return self._drop(len(self.where) - 1)


class Packer:
    """Documents of one task in order; hands back pieces of sequences whose cuts are settled."""

    def __init__(self, length: int):
        self.length, self.cutter = length, Cutter(length)
        self.end, self.begun, self.sequences, self.unsettled = 0, 0, 0, 0
        none = np.empty(0, np.int64)
        self.doc_ids: list = []
        self.begins, self.sizes, self.ids = [none], [none], [np.empty(0, np.uint32)]
        self.waiting: deque[tuple[np.ndarray, np.ndarray]] = deque()

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray, sentences: np.ndarray) -> None:
        """Documents with their ids one after the other, the number of ids of each, and places where sentences end."""
        where, cost = places(sentences, sizes)
        self.waiting.append((where + self.end, cost))
        self.doc_ids += doc_ids
        self.begins.append(self.end + np.cumsum(sizes) - sizes)
        self.sizes.append(sizes)
        self.ids.append(ids)
        self.end += len(ids)
        # The last ``length`` ids of a task have more places to cut, so all of them wait.
        while self.waiting and self.waiting[0][0][0] <= self.end - self.length:
            where, cost = self.waiting.popleft()
            ready = int(np.searchsorted(where, self.end - self.length, side="right"))
            self.cutter.extend(where[:ready], cost[:ready])
            self.unsettled += ready
            if ready < len(where):
                self.waiting.appendleft((where[ready:], cost[ready:]))
                break

    def ready(self) -> bool:
        return self.unsettled >= SETTLE

    def settled(self) -> dict:
        self.unsettled = 0
        return self._pieces(self.cutter.settled())

    def close(self) -> dict:
        """All that is left. In the last ``length`` ids every id is a place to cut, so that powers of two can be met."""
        begin = max(self.cutter.where[-1], self.end - self.length)
        where = np.arange(begin + 1, self.end + 1)
        cost = np.full(len(where), INNER_COST)
        for some, own in self.waiting:
            cost[some[some > begin] - begin - 1] = own[some > begin]
        self.cutter.extend(where, cost)
        return self._pieces(self.cutter.close() if self.end else [])

    def _pieces(self, cuts: list[int]) -> dict:
        if not cuts:
            return {}
        done = cuts[-1]
        begins, sizes, ids = (np.concatenate(parts) for parts in (self.begins, self.sizes, self.ids))
        starts = np.union1d(np.maximum(begins[begins < done], self.begun), np.array([self.begun, *cuts[:-1]]))
        owner = np.searchsorted(begins, starts, side="right") - 1
        edges = np.array([self.begun, *cuts])
        sequence = np.searchsorted(edges, starts, side="right") - 1
        found = {
            "doc_id": [self.doc_ids[i] for i in owner.tolist()], "start": starts - begins[owner], "length": np.diff(np.append(starts, done)),
            "doc_tokens": sizes[owner], "sequence": sequence + self.sequences, "offset": starts - edges[sequence], "ids": ids[: done - self.begun],
        }
        left = int(np.searchsorted(begins + sizes, done, side="right"))
        self.doc_ids, self.begins, self.sizes, self.ids = self.doc_ids[left:], [begins[left:]], [sizes[left:]], [ids[done - self.begun :]]
        self.begun, self.sequences = done, self.sequences + len(cuts)
        return found


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` has the piece's ids as little-endian unsigned 32-bit integers. A document's ids are those of the tokenizer
    file at ``path``, without special tokens, and ``end_id`` after them; the tokenizer must drop white space. Every id lies in one piece, a sequence has ``length`` ids at
    most and its pieces follow each other without gaps. Sequences are padded to ``length`` except at a power of two (that
    is the reader's work, see ``sequences``).

    One pass without a shuffle: each task packs the documents of its partition in the order of its files, so no
    sequence spans two tasks and an attempt after a lost executor gives the same rows. A task holds the ids whose cuts are not yet
    settled, some tens of thousands of places to cut; cuts are the cheapest of the whole partition.

    Null and empty texts have the end id alone. Rows repeated with one id are documents of their own. Very long texts
    are cut like any other. An empty table gives an empty result. Further columns are ignored.
    """
    id_type = dict(docs.dtypes)[id_col]
    small_batches(docs.sparkSession)

    def sent(found: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if found:
            task = TaskContext.get().partitionId() << 32
            offsets = np.concatenate([[0], np.cumsum(found["length"])]).astype(np.int32) * 4
            ids = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(found["ids"]))])
            longs = [pa.array(found[c].astype(np.int64)) for c in ("start", "length", "doc_tokens")]
            places = [pa.array(found["sequence"].astype(np.int64) + task), pa.array(found["offset"].astype(np.int64))]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            whole = pa.RecordBatch.from_arrays([pa.array(found["doc_id"], kind), *longs, *places, ids], names=names)
            for at in range(0, whole.num_rows, 4096):
                yield whole.slice(at, 4096)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, kind = words_of(path), Packer(length), pa.null()
        for batch in pieces(batches, 1):
            kind = batch.schema.field(0).type
            packer.add(batch.column(0).to_pylist(), *words.encode(batch.column(1), end_id))
            if packer.ready():
                yield from sent(packer.settled(), kind)
        yield from sent(packer.close(), kind)

    schema = f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(packed, schema)


def sequences(packed: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids: pieces joined in order, padded with ``pad_id`` to ``length`` unless n_tokens is a power of two.

    A group has at most ``length`` ids, so it fits any task.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_join(F.transform(parts, lambda p: p["ids"]), "").alias("ids"))
    pad = F.lit(pad_id.to_bytes(4, "little").hex())
    missing = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(length - F.col("n_tokens")).cast("int")
    return joined.select("sequence_id", "n_tokens", F.unhex(F.concat("ids", F.repeat(pad, missing))).alias("ids"))
