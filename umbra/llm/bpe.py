"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The merges are compiled into a trie of the vocabulary and a table of how each token was merged. A token may follow
another exactly if the merges would not cross their border; that makes a nondeterministic transducer whose states
are (trie node, last token). ``BpeTransducer`` determinises it while it reads: a state is the set of readings
still open, each with the tokens it has not emitted yet, and what all open readings agree on is emitted at once.
A reading stays open only while the bytes since its last border can still grow into a token, so the lookahead is
bounded by the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.batches import pieces, small_batches

#: Transitions, pairs of tokens and pieces that a worker remembers before it starts anew; they only bound memory.
MOST_TRANSITIONS, MOST_PAIRS, MOST_PIECES = 300_000, 150_000, 200_000

_WAITING = itemgetter(2)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


class BpeTransducer:
    """Encodes pieces of bytes by merge ranks, one byte at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.children: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                following = self.children.get(key)
                if following is None:
                    following = self.children[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = following
            self.token_at[node] = rank
        #: Rank of the merge of two tokens (left << 32 | right), and the two that each token was merged from.
        self.merged: dict[int, int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            if len(token) > 1:
                halves = self._merge(token, rank)
                if len(halves) == 2:
                    self.halves[rank] = (halves[0], halves[1])
                    self.merged[halves[0] << 32 | halves[1]] = rank
        self._pairs: dict[int, bool] = {}
        self._reset()

    def _merge(self, piece: bytes, below: int) -> list[int]:
        """Plain merging, lowest rank first, with merges of lower rank than ``below``."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging left's and right's bytes together leaves the border between them.

        Both sides are taken apart in the reverse of merge order; a merge across the border that would come
        before the one just undone would have crossed it.
        """
        a, b, limit, answer = left, right, 1 << 62, True
        merged, halves = self.merged.get, self.halves
        while True:
            if merged(a << 32 | b, limit) < limit:
                answer = False
                break
            open_a, open_b = halves[a], halves[b]
            if open_a is None and open_b is None:
                break
            # On the left a merge counts only if it is ranked before the crossing one; on the right ties go left.
            if open_b is None or (open_a is not None and a > b):
                limit, a = a, open_a[1]
            else:
                limit, b = b + 1, open_b[0]
        if len(self._pairs) > MOST_PAIRS:
            self._pairs.clear()
        self._pairs[left << 32 | right] = answer
        return answer

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self._numbers = {start: 0}
        self._readings = [start]
        self._finals: list[tuple[int, ...]] = [()]
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition, made when it is first met.

        A prefix of a piece has one encoding, so at most one reading has a border here; it comes last.
        """
        children, token_at, pairs = self.children.get, self.token_at, self._pairs.get
        readings, border = [], None
        for node, last, waiting in self._readings[state]:
            following = children(node << 8 | byte)
            if following is None:
                continue
            readings.append((following, last, waiting))
            token = token_at[following]
            if token >= 0 and border is None:
                fits = last < 0 or pairs(last << 32 | token)
                if fits or (fits is None and self.may_follow(last, token)):
                    border = (0, token, (*waiting, token))
        readings.append(border)
        emitted: tuple[int, ...] = ()
        shortest = min(map(len, map(_WAITING, readings)))
        if shortest:
            agreed, first = 0, readings[0][2]
            while agreed < shortest and all(r[2][agreed] == first[agreed] for r in readings):
                agreed += 1
            if agreed:
                emitted = first[:agreed]
                readings = [(node, last, waiting[agreed:]) for node, last, waiting in readings]
        key = tuple(readings)
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self._readings)
            self._readings.append(key)
            self._finals.append(key[-1][2])
        move = self._moves[state << 8 | byte] = (number, emitted)
        return move

    def encode(self, piece: bytes) -> list[int]:
        if len(self._moves) > MOST_TRANSITIONS:
            self._reset()
        out: list[int] = []
        state, moves = 0, self._moves
        for byte in piece:
            move = moves.get(state << 8 | byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        out += self._finals[state]
        return out


class Utf8Machine:
    """The states of UTF-8: how many bytes of a character are still to come and between which values the next one lies.

    State 0 is between characters. ``step`` reads a byte: the following state and whether the bytes read so far were
    given up (one U+FFFD for them). A byte that can't go on is read again from state 0.
    """

    #: First byte from, to; bytes to come; the next one from, to (fixed values: the well-formed sequences of the standard).
    LEADS = (
        (0xC2, 0xDF, 1, 0x80, 0xBF),
        (0xE0, 0xE0, 2, 0xA0, 0xBF),
        (0xE1, 0xEC, 2, 0x80, 0xBF),
        (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF),
        (0xF0, 0xF0, 3, 0x90, 0xBF),
        (0xF1, 0xF3, 3, 0x80, 0xBF),
        (0xF4, 0xF4, 3, 0x80, 0x8F),
    )

    def __init__(self) -> None:
        self.states: list[tuple[int, int, int]] = [(0, 0, 0)]
        numbers = {self.states[0]: 0}

        def number(state: tuple[int, int, int]) -> int:
            if state not in numbers:
                numbers[state] = len(self.states)
                self.states.append(state)
            return numbers[state]

        self.lead = [-1] * 256  # -1: no character begins with this byte
        self.lead[:0x80] = [0] * 0x80
        for first, last, need, low, high in self.LEADS:
            for byte in range(first, last + 1):
                self.lead[byte] = number((need, low, high))
        for need in (2, 1):
            number((need, 0x80, 0xBF))
        self.after = [0 if need < 2 else numbers[need - 1, 0x80, 0xBF] for need, _, _ in self.states]

    def step(self, state: int, byte: int) -> tuple[int, bool]:
        if state:
            _, low, high = self.states[state]
            return (self.after[state], False) if low <= byte <= high else (0, True)
        following = self.lead[byte]
        return (0, True) if following < 0 else (following, False)


class Utf8Stream:
    """Decodes tokens as they come, by the UTF-8 machine lifted to tokens.

    A state is the machine's state with the bytes of the unfinished character. What a token does in a state (the
    characters it completes, the state it leaves) is worked out byte by byte once and remembered; in state 0 most
    tokens are whole characters. Bytes that can't be UTF-8 become U+FFFD, one for each longest beginning of a character.
    """

    def __init__(self, vocabulary: list[bytes], machine: Utf8Machine | None = None):
        self.vocabulary, self.machine = vocabulary, machine or Utf8Machine()
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.whole: list[str | None] = [None] * len(vocabulary)  # in state 0, tokens that end there
        self.open = b""

    def _read(self, token: int) -> tuple[str, bytes]:
        machine, out, state, pending = self.machine, [], 0, bytearray()
        data = self.open + self.vocabulary[token]
        at = 0
        while at < len(data):
            before, byte = state, data[at]
            state, given_up = machine.step(before, byte)
            if given_up:
                out.append("\ufffd")
                pending.clear()
                at += 0 if before else 1
                continue
            pending.append(byte)
            at += 1
            if not state:
                out.append(pending.decode("utf-8"))
                pending.clear()
        return "".join(out), bytes(pending)

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        whole = self.whole
        for token in ids:
            if not self.open:
                text = whole[token]
                if text is not None:
                    out.append(text)
                    continue
            move = self.moves.get((self.open, token))
            if move is None:
                move = self._read(token)
                if not self.open and not move[1]:
                    whole[token] = move[0]
                else:
                    if len(self.moves) >= MOST_TRANSITIONS:
                        self.moves.clear()
                    self.moves[self.open, token] = move
            text, self.open = move
            out.append(text)
        return "".join(out)

    def close(self) -> str:
        rest, self.open = "\ufffd" if self.open else "", b""
        return rest


class Codec:
    """Text to ids and back: split by the pattern, each piece through the transducer, known pieces from a table."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.transducer = BpeTransducer(ranks)
        self.find = regex.compile(pattern).findall
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.known: dict[str, bytes] = {}
        self.stream = Utf8Stream(self.vocabulary)

    def piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        whole = self.transducer.ranks.get(data)
        packed = array("I", [whole] if whole is not None else self.transducer.encode(data)).tobytes()
        if len(piece) < 64:
            if len(self.known) >= MOST_PIECES:
                self.known.clear()
            self.known[piece] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        get, make = self.known.get, self.piece
        return np.frombuffer(b"".join([get(p) or make(p) for p in self.find(text)]), dtype="<u4")

    def decode(self, ids: np.ndarray, chunk: int = 8192) -> Iterator[str]:
        self.stream.close()
        for at in range(0, len(ids), chunk):
            yield self.stream.feed(ids[at : at + chunk].tolist())
        yield self.stream.close()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec, built once; a worker holds one at a time."""
    if (path, pattern) not in _codecs:
        _codecs.clear()
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, token_ids.

    ``path`` is a vocabulary file of base64 tokens and ranks that every worker can open. Each match of ``pattern``
    is encoded separately, without special tokens. The ids are decoded again through the streaming decoder, and
    decoded_sha256 is the digest of what comes out. One pass over the text, no shuffle.

    Null text counts as empty: no ids. Ids may be null or repeated; an empty table gives an empty result.
    """
    id_type = dict(docs.dtypes)[id_col]
    small_batches(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(path, pattern)
        for batch in pieces(batches, 1, 1 << 20):
            counts, digests, round_trips, ids_of = [], [], [], []
            for text in batch.column(1):
                ids = worker.encode(text.as_py() or "")
                back = hashlib.sha256()
                for part in worker.decode(ids):
                    back.update(part.encode("utf-8"))
                counts.append(len(ids))
                digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                round_trips.append(back.hexdigest())
                if keep_ids:
                    ids_of.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(round_trips, pa.string())]
            if keep_ids:
                flat = np.concatenate(ids_of).astype(np.int32) if ids_of else np.empty(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(columns)])

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded, schema)
