"""Language-model scoring: a causal self-attention model on subword ids, trained in numpy, that gates counted experts.

The training documents fall into a few clusters (languages, domains). Words and subwords are counted by cluster over
all of them. The attention model reads the subwords before a place and says how much each cluster's counts are to be
trusted there; a word's probability mixes its gated counts, its plain count and the product of its subwords.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.batches import pieces, small_batches
from umbra.shared import stash

#: Context window in subwords, new targets of each further window, width of the model.
WINDOW, STRIDE, WIDTH = 32, 24, 16
#: Clusters of documents; bits and numbers of a document's direction; ids with an input class of their own.
CLUSTERS, BITS, PLACES, OWN = 8, 6, 8, 48
#: Training: each document gives one in ``SHARE`` of its segments of ``SEGMENT`` bytes, which is all of them; rounds, passes over each.
SHARE, SEGMENT, ROUNDS, EPOCHS = 1, 160, 3, 1
#: Words whose counts go to every task; all others meet their counts in a join.
HEAD = 200_000
#: Weights of the plain count, of the subwords and, in shares of words seen once, of new words: the likeliest on training words.
PLAIN, SUBWORDS, FRESH = (0.02, 0.05, 0.1, 0.2, 0.4), (0.01, 0.05, 0.15), (0.02, 0.2, 1.0)
#: Words that a worker remembers before it starts anew.
MOST_WORDS = 200_000
#: Bytes of text whose tokens are held as arrays at once.
MOST_BYTES = 1 << 20
#: Steps of one in the sums of directions (whole numbers add up the same in any order).
FINE = 1 << 16


def may_train(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 != 2, F.lit(True))


class Words:
    """Numbers, 64-bit hashes and subword ids of words, remembered by the worker; number 0 is the end."""

    def __init__(self, path: str):
        import tiktoken
        import xxhash

        from umbra.llm.bpe import read_ranks

        ranks = read_ranks(path)
        self.digest = xxhash.xxh64_digest
        self.end = max(ranks.values()) + 1
        #: Ids that begin a word; the end stands for a word.
        self.begins = np.zeros(self.end + 1, np.int64)
        self.begins[[rank for token, rank in ranks.items() if token[:1] == b" "] + [self.end]] = 1
        # Words hold no spaces, so that " a b" is cut before each space, whatever else a word is made of.
        self.encode = tiktoken.Encoding("words", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.start()

    def start(self) -> None:
        """Forget all words but the end."""
        self.known: dict[bytes, int] = defaultdict(count(1).__next__)
        self.keys, self.packed = np.zeros(1, np.int64), np.array([self.end], np.uint32)
        self.begin, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[int]]:
        """Numbers of the texts' words with an end after each text, and how many each text has.

        Words not met before are encoded in one call. Where too many are remembered, numbering starts anew.
        """
        if len(self.known) > MOST_WORDS:
            self.start()
        before, numbers, sizes = len(self.known), [], []
        for own in texts:
            numbers += map(self.known.__getitem__, own)
            numbers.append(0)
            sizes.append(len(own) + 1)
        names = list(islice(self.known, before, None))
        if names:
            ids = self.encode((b" " + b" ".join(names)).decode("utf-8"), disallowed_special=())
            first = np.flatnonzero(self.begins[ids])
            self.keys = np.r_[self.keys, np.frombuffer(b"".join(map(self.digest, names)), ">i8").astype(np.int64)]
            self.begin = np.r_[self.begin, first + len(self.packed)]
            self.size = np.r_[self.size, np.diff(np.r_[first, len(ids)])]
            self.packed = np.r_[self.packed, ids]
        return np.array(numbers, np.int64), sizes


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _words:
        _words.clear()
        _words[path] = Words(path)
    return _words[path]


class Tokens:
    """Tokens of a few documents as arrays: words (an end after each document, numbered 0) and the subwords of each."""

    def __init__(self, texts: list[list[bytes]], look_up: Words, subwords: bool = True):
        numbers, sizes = look_up(texts)
        met = np.zeros(len(look_up.size), bool)
        met[numbers] = met[0] = True
        here = np.flatnonzero(met)
        place = np.empty(len(met), np.int64)
        place[here] = np.arange(len(here))
        self.word, self.is_end, self.keys = place[numbers], numbers == 0, look_up.keys[here]
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.packed, self.begin, self.size = look_up.packed, look_up.begin[here], look_up.size[here]
        n = self.size[self.word]
        self.first = np.cumsum(n) - n
        if subwords:
            self.ids = self.packed[np.repeat(self.begin[self.word] - self.first, n) + np.arange(int(n.sum()))].astype(np.int64)
            self.doc_of_id = np.repeat(self.doc, n)

    def own(self, words: np.ndarray) -> np.ndarray:
        """The subwords of these numbers' words, one after the other."""
        n = self.size[words]
        first = np.cumsum(n) - n
        return self.packed[np.repeat(self.begin[words] - first, n) + np.arange(int(n.sum()))].astype(np.int64)


def _codes(size: int) -> np.ndarray:
    return np.random.default_rng(3).standard_normal((size, PLACES)).astype(np.float32)


def directions(tokens: Tokens, code: np.ndarray) -> np.ndarray:
    """For each document the sum of its subwords' random codes, at length one."""
    every = np.arange(len(tokens.size))
    by_word = np.add.reduceat(code[tokens.own(every)], np.cumsum(tokens.size) - tokens.size)
    starts = np.flatnonzero(np.r_[True, tokens.doc[1:] != tokens.doc[:-1]])
    sums = np.add.reduceat(np.take(by_word, tokens.word, axis=0), starts)
    return sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-6)


def cells(direction: np.ndarray) -> np.ndarray:
    """The signs of a direction's first numbers: near documents share a cell, or lie in few."""
    return (direction[:, :BITS] > 0) @ (1 << np.arange(BITS))


def clusters_of(sums: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """A cluster for each cell: k-means over the cells' mean directions, weighted by documents, from far-apart cells on."""
    seen = np.flatnonzero(amounts > 0)
    out = np.zeros(len(amounts), np.int64)
    if not len(seen):
        return out
    mean = sums[seen] / (np.linalg.norm(sums[seen], axis=1, keepdims=True) + 1e-6)
    weight = amounts[seen].astype(float)
    centres = [mean[weight.argmax()]]
    while len(centres) < min(CLUSTERS, len(seen)):
        apart = (1 - (mean @ np.array(centres).T).max(axis=1)) * np.sqrt(weight)
        centres.append(mean[apart.argmax()])
    middle = np.array(centres)
    for _ in range(12):
        near = (mean @ middle.T).argmax(axis=1)
        for k in np.unique(near):
            total = (mean[near == k] * weight[near == k, None]).sum(axis=0)
            middle[k] = total / (np.linalg.norm(total) + 1e-6)
    out[seen] = (mean @ middle.T).argmax(axis=1)
    return out


def windows(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of overlapping windows over tokens sorted by document, and which of each window's targets count.

    A document's first window counts all its targets, each further one its last ``STRIDE``: every token counts once.
    """
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    length = np.diff(np.r_[first, len(doc)])
    more = np.maximum(0, -(-(length - WINDOW) // STRIDE))
    of = np.repeat(np.arange(len(first)), more + 1)
    number = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    place = np.arange(WINDOW)[None, :] + (number * STRIDE)[:, None]
    counts = (place < length[of][:, None]) & ((number == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE)[None, :])
    return np.where(place < length[of][:, None], place + first[of][:, None], first[of][:, None]), counts


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums along the last axis, which stays; on short axes a product is much faster than a reduction."""
    return values @ np.ones((values.shape[-1], 1), np.float32)


class Attention:
    """One causal self-attention layer and a residual layer; the output weighs experts (role, cluster) of subwords.

    It starts as a plain average of what the subwords before say about the clusters, and learns by Adam.
    """

    def __init__(self, evidence: np.ndarray, prior: np.ndarray, seed: int = 5):
        """evidence: input classes x clusters; prior: log share of each expert, roles by clusters."""
        draw = np.random.default_rng(seed)
        d, k = WIDTH, evidence.shape[1]
        small = lambda *shape: (draw.standard_normal(shape) * 0.05).astype(np.float32)
        embed, attend, out, top = small(len(evidence), d), small(d, 3 * d), small(d, d), small(d, prior.size)
        embed[:, :k] += evidence
        attend[:k, 2 * d : 2 * d + k] += np.eye(k, dtype=np.float32)
        out[:k, d - k :] += 4 * np.eye(k, dtype=np.float32)
        for role in range(prior.shape[0]):
            top[d - k :, role * k : (role + 1) * k] += np.eye(k, dtype=np.float32)
        self.p = {"E": embed, "P": small(WINDOW, d), "A": attend, "O": out, "F": small(d, d), "U": top, "b": prior.ravel().astype(np.float32)}
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.moments: tuple[dict, dict, int] | None = None
        self.ready: tuple[list[np.ndarray], bool] | None = None

    def forward(self, inputs: np.ndarray) -> tuple:
        p, d = self.p, WIDTH
        x = p["E"][inputs] + p["P"]
        q, k, v = np.split(x @ p["A"], 3, axis=2)
        scores = q @ k.transpose(0, 2, 1) * np.float32(d**-0.5) + self.mask
        weights = np.exp(np.minimum(scores, 60, out=scores), out=scores)
        weights /= _sums(weights)
        mixed = weights @ v
        h = x + mixed @ p["O"]
        t = np.maximum(h @ p["F"], 0)
        z = h + t
        return x, q, k, v, weights, mixed, h, t, z

    def tables(self) -> tuple[list[np.ndarray], bool]:
        """What ``gate`` looks up: scaled query, key and value of each input class and place, with a one beside the values."""
        if self.ready is None:
            p, d = self.p, WIDTH
            scale = np.r_[np.full(d, d**-0.5, np.float32), np.ones(2 * d, np.float32)]
            by_class = np.c_[p["E"] @ p["A"] * scale, np.ones(len(p["E"]), np.float32)]
            by_place = np.c_[p["P"] @ p["A"] * scale, np.zeros(WINDOW, np.float32)]
            size = lambda part: float(np.linalg.norm(by_class[:, part], axis=1).max() + np.linalg.norm(by_place[:, part], axis=1).max())
            self.ready = [by_class, by_place], size(slice(0, d)) * size(slice(d, 2 * d)) > 60
        return self.ready

    def gate(self, inputs: np.ndarray, counted: np.ndarray, skip: int = 0) -> np.ndarray:
        """Weights of the experts at each place that counts, in order; ``forward`` without what training needs.

        The first ``skip`` places of each window count nowhere: they are attended to, but ask nothing.
        """
        p, d = self.p, WIDTH
        (by_class, by_place), large = self.tables()
        own = np.take(by_class, inputs, axis=0)
        own += by_place
        weights = own[:, skip:, :d] @ own[:, :, d : 2 * d].transpose(0, 2, 1)
        weights += self.mask[skip:]
        if large:
            np.minimum(weights, 60, out=weights)
        np.exp(weights, out=weights)
        # The ones beside the values give the sums that the weights are divided by.
        at = np.flatnonzero(counted[:, skip:])
        mixed = np.take((weights @ own[:, :, 2 * d :]).reshape(-1, d + 1), at, axis=0)
        h = np.take(p["E"], np.take(inputs[:, skip:], at), axis=0)
        h += np.take(p["P"], at % (WINDOW - skip) + skip, axis=0)
        mixed[:, :d] /= mixed[:, d:]
        h += mixed[:, :d] @ p["O"]
        h += np.maximum(h @ p["F"], 0)
        logits = h @ p["U"]
        logits += p["b"]
        np.minimum(logits, 60, out=logits)
        np.exp(logits, out=logits)
        logits /= (logits @ np.ones(logits.shape[1], np.float32))[:, None]
        return logits

    def gradients(self, inputs: np.ndarray, shares: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """shares: the probability that each expert gives the target (0 for experts of the other role)."""
        p, d = self.p, WIDTH
        x, q, k, v, weights, mixed, h, t, z = self.forward(inputs)
        logits = z @ p["U"] + p["b"]
        y = np.exp(np.minimum(logits, 60, out=logits), out=logits)
        y /= _sums(y)
        met = y * shares
        met /= _sums(met) + np.float32(1e-30)
        y -= met
        y *= (counts / max(1.0, float(counts.sum())))[:, :, None]
        flat = lambda a: a.reshape(-1, a.shape[-1])
        g = {"U": flat(z).T @ flat(y), "b": flat(y).sum(axis=0)}
        dz = y @ p["U"].T
        dt = dz * (t > 0)
        g["F"] = flat(h).T @ flat(dt)
        dh = dz + dt @ p["F"].T
        g["O"] = flat(mixed).T @ flat(dh)
        dm = dh @ p["O"].T
        dw = dm @ v.transpose(0, 2, 1)
        dv = weights.transpose(0, 2, 1) @ dm
        dw -= _sums(dw * weights)
        ds = np.multiply(dw, weights, out=dw)
        ds *= np.float32(d**-0.5)
        da = np.concatenate([ds @ k, ds.transpose(0, 2, 1) @ q, dv], axis=2)
        g["A"] = flat(x).T @ flat(da)
        dx = dh + da @ p["A"].T
        g["P"] = dx.sum(axis=0)
        g["E"] = np.zeros_like(p["E"])
        order = np.argsort(inputs.astype(np.uint8).ravel(), kind="stable")  # there are fewer than 256 classes
        classes = inputs.ravel()[order]
        starts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
        g["E"][classes[starts]] = np.add.reduceat(np.take(flat(dx), order, axis=0), starts, axis=0)
        return g

    def learn(self, inputs: np.ndarray, shares: np.ndarray, counts: np.ndarray, order: np.ndarray, rate: float, batch: int) -> None:
        """One pass by Adam in the given order; the moments go on from the pass before."""
        zeros = lambda: {k: np.zeros_like(v) for k, v in self.p.items()}
        m, s, step = self.moments or (zeros(), zeros(), 0)
        self.ready = None
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            step += 1
            for key, g in self.gradients(inputs[some], shares[some], counts[some]).items():
                m[key] += 0.1 * (g - m[key])
                s[key] += 0.01 * (g * g - s[key])
                self.p[key] -= (rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(s[key] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        self.moments = m, s, step


class Model:
    """Experts (what the whole training corpus counts by cluster) and the attention model that gates them."""

    def __init__(self, by_cluster: np.ndarray, begins: np.ndarray):
        """by_cluster: ids x clusters, how often each subword occurs; begins: 1 for ids that begin a word."""
        self.begins = begins
        amounts = by_cluster.sum(axis=1)
        role_total = np.bincount(begins, weights=amounts + 1.0, minlength=2)
        share = (amounts + 1.0) / role_total[begins]
        totals = np.stack([np.bincount(begins, weights=c, minlength=2) for c in by_cluster.T], axis=1)
        #: ids x clusters: probability of the subword among those of its role in a cluster, smoothed by the whole corpus.
        self.expert = ((by_cluster + 100 * share[:, None]) / (totals + 100)[begins]).astype(np.float32)
        prior = np.log((totals + 1) / (totals + 1).sum())
        # Input classes: frequent ids by themselves, others by role and likeliest cluster, last the start of a text.
        likely = ((by_cluster + 1) / (by_cluster.sum(axis=0) + 1)).argmax(axis=1)
        self.classes = OWN + begins * CLUSTERS + likely
        self.classes[np.argsort(-amounts, kind="stable")[:OWN]] = np.arange(OWN)
        n = OWN + 2 * CLUSTERS + 1
        mass = np.stack([np.bincount(self.classes, weights=c, minlength=n) for c in by_cluster.T], axis=1)
        of_cluster = (by_cluster.sum(axis=0) + 1) / (by_cluster.sum() + CLUSTERS)
        evidence = np.log((mass + 5 * of_cluster) / (mass.sum(axis=1, keepdims=True) + 5) / of_cluster)
        self.net = Attention(np.clip(evidence, -3, 3).astype(np.float32), prior)
        #: Subwords that the net was trained on, each counted once.
        self.trained = 0

    def inputs(self, tokens: Tokens) -> np.ndarray:
        """Class of the subword before each (the start's at a document's first)."""
        before = np.r_[0, self.classes[tokens.ids[:-1]]]
        before[np.r_[True, tokens.doc_of_id[1:] != tokens.doc_of_id[:-1]]] = len(self.net.p["E"]) - 1
        return before

    def train(self, tokens: Tokens, draw: np.random.Generator, rate: float, batch: int = 64) -> None:
        """``EPOCHS`` passes over the tokens."""
        before, role, own = self.inputs(tokens), self.begins[tokens.ids], self.expert[tokens.ids]
        place, counts = windows(tokens.doc_of_id)
        shares = np.concatenate([own * (1 - role)[:, None], own * role[:, None]], axis=1).astype(np.float32)
        self.trained += int(counts.sum())
        for _ in range(EPOCHS):
            self.net.learn(before[place], shares[place], counts.astype(np.float32), draw.permutation(len(place)), rate, batch)

    def word_scores(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """For every word (and end) its subwords' log10 probability, and the gate over clusters at its start.

        Whether a word goes on or the next begins is told by the role of the next subword; that a word ends is counted
        with the word itself, so that the probabilities of all words add up to one at a place.
        """
        before, role = self.inputs(tokens), self.begins[tokens.ids]
        place, counts = windows(tokens.doc_of_id)
        gate = np.empty((len(tokens.ids), 2 * CLUSTERS), np.float32)
        opens = counts[:, 0]  # a document's first window counts from its first place
        for part, skip in ((opens, 0), (~opens, WINDOW - STRIDE)):
            places, counting = place[part], counts[part]
            for at in range(0, len(places), 128):  # so that a step's arrays stay in the cache
                some, counted = places[at : at + 128], counting[at : at + 128]
                gate[some[counted]] = self.net.gate(before[some], counted, skip)
        met = np.take(gate.reshape(-1, CLUSTERS), 2 * np.arange(len(role)) + role, axis=0)
        met *= np.take(self.expert, tokens.ids, axis=0)
        log_p = np.log(met @ np.ones(CLUSTERS, np.float32) + np.float32(1e-30))
        gate = gate.reshape(-1, 2, CLUSTERS)
        start = gate[tokens.first, 1]
        begin = start.sum(axis=1)
        begin_log = np.log(begin + 1e-30)
        log_p[tokens.first] -= begin_log
        word = np.add.reduceat(log_p.astype(np.float64), tokens.first)
        word[:-1] += np.where(tokens.is_end[:-1], 0, begin_log[1:])
        return word / np.log(10), start / (begin[:, None] + 1e-30)


def _own_words(text) -> list[bytes]:
    return text.as_buffer().to_pybytes().lower().split()


def _segments(text) -> list[list[bytes]]:
    """All segments of a text, one at least, split into words; each word lies in one of them.

    A segment is what begins in ``SEGMENT`` consecutive bytes, from the first space on, and ends with a whole word.
    """
    data = text.as_buffer().to_pybytes()
    n = max(1, -(-len(data) // SEGMENT))
    found = []
    for i in range(n):
        lo = data.find(b" ", i * SEGMENT - 1, (i + 1) * SEGMENT) + 1 if i else 0
        if i and not lo:
            continue
        hi = data.find(b" ", (i + 1) * SEGMENT - 1)
        found.append(data[lo : hi if hi >= 0 else len(data)].lower().split())
    return found


def train_model(segments: DataFrame, path: str, by_cluster: np.ndarray, rate: float = 3e-3) -> Model:
    """The model whose gate is trained on segments (number, segment) of all training documents.

    The segments are shared out over ``ROUNDS``. In a round, every task goes on from the same parameters over its rows, and
    the mean of the tasks' parameters, weighted by their subwords, starts the next round. Only parameters reach the driver.
    """
    model = Model(by_cluster, words_of(path).begins)
    spark = segments.sparkSession
    for number in range(ROUNDS):
        held = spark.sparkContext.broadcast(model)
        now = rate * (1 - 0.8 * number / ROUNDS)

        def trained(batches: Iterator[pa.RecordBatch], held=held, now=now, number=number) -> Iterator[pa.RecordBatch]:
            look_up, own = words_of(path), None
            draw = np.random.default_rng(11 + number)
            for batch in pieces(batches, 0, MOST_BYTES // 2):
                if own is None:
                    own = Model(by_cluster=np.zeros((len(held.value.begins), CLUSTERS)), begins=held.value.begins)
                    own.expert, own.classes = held.value.expert, held.value.classes
                    own.net.p = {k: v.copy() for k, v in held.value.net.p.items()}
                own.train(Tokens([segment.as_py().split() for segment in batch.column(0)], look_up), draw, now)
            if own is not None:
                flat = np.concatenate([v.ravel() for v in own.net.p.values()])
                yield pa.RecordBatch.from_arrays([pa.array([own.trained]), pa.array([flat.tobytes()], pa.binary())], names=["n", "p"])

        share = segments.where(F.pmod(F.xxhash64("segment"), F.lit(ROUNDS)) == number).select("segment")
        total, mean = 0, 0.0
        for row in share.mapInArrow(trained, "n long, p binary").collect():
            total += row["n"]
            mean = mean + (np.frombuffer(row["p"], np.float32) - mean) * (row["n"] / total)
        at = 0
        for key, value in model.net.p.items() if total else ():
            model.net.p[key] = mean[at : at + value.size].reshape(value.shape).astype(np.float32)
            at += value.size
        model.trained += total
        held.destroy()
    return model


def _cut(training: DataFrame) -> DataFrame:
    """number, segment: the training segments of every document, numbered within it, lower-cased."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, b" ".join(words)) for text in batch.column(0) for i, words in enumerate(_segments(text))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([s for _, s in found], pa.binary())], names=["number", "segment"])

    return training.mapInArrow(cut, "number int, segment binary")


def _counts(training: DataFrame, path: str) -> DataFrame:
    """kind, key, cell, n: words by hash (0), subwords by id (1), and documents (key -1) and sums of directions of cells (2).

    Subwords are counted by different words rather than by occurrences, and everything is added up inside tasks first.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = words_of(path)
        size, n_cells = look_up.end + 1, 1 << BITS
        code = _codes(size)
        subwords, sums, amounts = np.zeros(size * n_cells), np.zeros((n_cells, PLACES), np.int64), np.zeros(n_cells, np.int64)

        def rows(kind: int, key: np.ndarray, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            columns = [np.full(len(key), kind, np.int32), key, cell.astype(np.int32), n.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "cell", "n"])

        for batch in pieces(batches, 0, 3 * MOST_BYTES):
            tokens = Tokens([_own_words(text) for text in batch.column(0)], look_up, subwords=False)
            direction = directions(tokens, code)
            cell = cells(direction)
            np.add.at(sums, cell, np.rint(direction * FINE).astype(np.int64))
            amounts += np.bincount(cell, minlength=n_cells)
            pair, n = np.unique(tokens.word * n_cells + cell[tokens.doc], return_counts=True)
            word, at = pair // n_cells, pair % n_cells
            ids, times = tokens.own(word), tokens.size[word]
            subwords += np.bincount(ids * n_cells + np.repeat(at, times), weights=np.repeat(n, times), minlength=size * n_cells)
            inner = word > 0
            yield rows(0, tokens.keys[word[inner]], at[inner], n[inner])
        some = np.flatnonzero(subwords)
        yield rows(1, some // n_cells, some % n_cells, subwords[some])
        some = np.flatnonzero(amounts)
        yield rows(2, np.full(len(some), -1), some, amounts[some])
        for place in range(PLACES):
            yield rows(2, np.full(len(some), place), some, sums[some, place])

    parts = training.select("text").mapInArrow(counted, "kind int, key long, cell int, n long")
    return parts.groupBy("kind", "key", "cell").agg(F.sum("n").alias("n"))


class Mixture:
    """What a word's probability is made of, from its count c, its gated count and its subwords.

    ``plain`` weighs the base, ``subwords`` the product of subwords of any word, ``fresh`` the product of subwords of a
    word without a count, divided by what the subwords leave to such words so that it adds up to one over them; the
    gated counts have the rest. A word without a count also has what the base gives its one unknown type, in full.
    """

    def __init__(self, n_all: int, v_all: int, once: float, in_head: float):
        """once: the share of words seen once, about how likely a new word is."""
        self.floor = float(np.log10(n_all + v_all + 1))
        self.n_all, self.v_all, self.in_head = n_all, v_all, in_head
        self.once = min(0.5, once)
        self.left = 1.0
        self.choice = (0.1, 0.01, 0.1 * self.once)
        self.choices = [(a, b, c * self.once) for a in PLAIN for b in SUBWORDS for c in FRESH if a + b + c * self.once < 1]

    def parts(self, choice: tuple[float, float, float]) -> tuple[float, float, float, float, float]:
        """Weights: gated count of a head word; c+1 of a head word, and of another known word; subwords of a known word, of a new one."""
        plain, subwords, fresh = choice
        counts = 1 - plain - subwords - fresh
        base = plain * 10**-self.floor
        return counts * self.in_head, base, base + counts / max(1, self.n_all + self.v_all), subwords, subwords + fresh / self.left

    def of(self, c, in_head, gated, lm, choice: tuple[float, float, float] | None = None) -> Column:
        """log10 of the probability as a column; c without the word itself where the weights are fitted."""
        counts, head, known, subwords, fresh = self.parts(choice or self.choice)
        spelling = F.pow(F.lit(10.0), lm)
        value = F.when(in_head & (c > 0), F.lit(counts) * gated + F.lit(head) * (c + 1.0) + F.lit(subwords) * spelling)
        value = value.when(c > 0, F.lit(known) * (c + 1.0) + F.lit(subwords) * spelling)
        return F.log10(value.otherwise(F.lit(10**-self.floor) + F.lit(fresh) * spelling))

    def weights(self) -> np.ndarray:
        """For each choice, the one to start with last, the weights of a counted head word's gated count, c+1 and subwords."""
        return np.array([[parts[0], parts[1], parts[3]] for parts in map(self.parts, [*self.choices, self.choice])])

    def fit(self, rest: DataFrame, shares: float, amount: float, sums: np.ndarray) -> int:
        """Place of the likeliest weights on training words, each judged without its own occurrence; the last without any.

        ``sums`` are the logarithms of head words that occur elsewhere too, ``shares`` and ``amount`` what they add to the mean that
        tells what the subwords leave to new words; ``rest`` has lm and n of all others.
        """
        share = F.pow(F.lit(10.0), F.col("lm")) * F.lit(float(self.n_all)) / F.col("n")
        more, number = rest.agg(F.coalesce(F.sum(share), F.lit(0.0)), F.count(F.lit(1))).first()
        if amount + number == 0:
            return len(self.choices)
        self.left = float(np.clip(1 - (shares + more) / (amount + number), self.once, 1))
        c = F.col("n") - 1
        met = rest.agg(*(F.coalesce(F.sum(self.of(c, F.lit(False), F.lit(0.0), F.col("lm"), choice)), F.lit(0.0)) for choice in self.choices)).first()
        best = int(np.argmax(sums[: len(self.choices)] + np.array(met)))
        self.choice = self.choices[best]
        return best


def _log_sums(features: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each part that begins at ``starts`` the sums of log10 of its rows' features times each choice's weights.

    Up to 16 values, none below a hundredth of the base's smallest, are multiplied before a logarithm is taken.
    """
    at = np.arange(len(features)) - np.repeat(starts, np.diff(np.r_[starts, len(features)]))
    blocks = np.flatnonzero(at % 16 == 0)
    logs = np.empty((len(blocks), len(weights)))
    for lo in range(0, len(blocks), 512):  # so that a step's arrays stay in the cache
        some = blocks[lo : lo + 512]
        end = blocks[lo + 512] if lo + 512 < len(blocks) else len(features)
        logs[lo : lo + 512] = np.log10(np.multiply.reduceat(features[some[0] : end] @ weights.T, some - some[0], axis=0))
    return np.add.reduceat(logs, np.searchsorted(blocks, starts), axis=0)


def score_language(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    One pass counts words and subwords of all training documents by the cell of the document (signs of a random
    projection of its subwords); cells are merged into ``CLUSTERS``. The attention model is trained to gate the clusters'
    subword counts on segments of every training document (``train_model``). Every text is scored in overlapping windows.
    A word's probability is a ``Mixture`` of its base, its subwords' product and its counts, for the ``HEAD`` most
    frequent words by cluster under the gate; its weights are the likeliest on all training words,
    found while scoring: a text's sum is taken for every choice of weights and the likeliest choice's stays. Counts of
    these words go to every task; all others meet their counts in a join.

    Null text counts as empty: its only token is the end. A null id counts as training. Repeated rows are scored, and
    counted, each time. Without training documents every count is 0. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), may_train(F.col(id_col)).alias("trains"), text)
    training = rows.where("trains").select("text")

    counts = stash(_counts(training, path), "language-counts")
    n_cells, size = 1 << BITS, words_of(path).end + 1
    found = counts.where("kind = 2").select("cell", "key", "n").toPandas().to_numpy(np.int64).reshape(-1, 3)
    cell_sums = np.zeros((n_cells, PLACES + 1))
    cell_sums[found[:, 0], found[:, 1]] = found[:, 2]
    sums, amounts = cell_sums[:, :PLACES] / FINE, cell_sums[:, PLACES]
    merged = clusters_of(sums, amounts)
    by_cluster = np.zeros((size, CLUSTERS))
    cluster = F.element_at(F.lit(merged.tolist()), F.col("cell") + 1).alias("cluster")
    subwords = counts.where("kind = 1").groupBy("key", cluster).agg(F.sum("n").alias("n")).toPandas().to_numpy(np.int64).reshape(-1, 3)
    by_cluster[subwords[:, 0], subwords[:, 1]] = subwords[:, 2]

    words = stash(
        counts.where("kind = 0").groupBy("key").agg(
            F.sum("n").alias("n"), *(F.sum(F.when(F.element_at(F.lit(merged.tolist()), F.col("cell") + 1) == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(CLUSTERS))
        ),
        "language-words",
    )
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("once")).first()
    ends = by_cluster[-1]
    n_all, v_all = int(totals["n"] + ends.sum()), int(totals["v"] + (ends.sum() > 0))
    # The head is cut at a step of the counts' logarithm, so that no task has to sort the words.
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted((tuple(r) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
    room = np.cumsum([n for _, n in steps])
    least = steps[int(np.searchsorted(room, HEAD, "right")) - 1][0] if steps and room[0] <= HEAD else None
    head = words.where(step >= least if least is not None else F.lit(False)).toPandas().to_numpy(np.int64).reshape(-1, 2 + CLUSTERS)
    head = head[np.argsort(head[:, 0])]
    keys, amounts = head[:, 0].copy(), np.r_[int(ends.sum()), head[:, 1]]
    parts = np.concatenate([ends[None, :], head[:, 2:]])
    # A pseudo-count of one for each word, as in the base, divided among the clusters as its counts are.
    parts = parts * (1 + 1 / np.maximum(amounts, 1))[:, None]
    in_head = min(1.0, float((amounts + 1).sum()) / max(1, n_all + v_all))
    table = (parts / np.maximum(parts.sum(axis=0), 1)).astype(np.float32)
    mixture = Mixture(n_all, v_all, (totals["once"] + 1) / (n_all + 1), in_head)
    floor = mixture.floor

    segments = stash(_cut(training), "language-segments")
    model = train_model(segments, path, by_cluster)
    held = docs.sparkSession.sparkContext.broadcast((model, keys, amounts, table))

    def met(tokens: Tokens, keys: np.ndarray, table: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its row in the head's table (0 the end, -1 none) and its gated count."""
        at = np.minimum(np.searchsorted(keys, tokens.keys), max(0, len(keys) - 1))
        row = np.where(keys[at] == tokens.keys, at + 1, -1) if len(keys) else np.full(len(tokens.keys), -1)
        row[0] = 0
        row = row[tokens.word]
        return row, np.einsum("ij,ij->i", gate, table[row])

    weights = mixture.weights()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = words_of(path)
        model, keys, amounts, table = held.value
        for batch in pieces(batches, 2, MOST_BYTES):
            tokens = Tokens([_own_words(text) for text in batch.column(2)], look_up)
            lm, gate = model.word_scores(tokens)
            row, gated = met(tokens, keys, table, gate)
            settled = row >= 0
            c = np.where(settled, amounts[row], 0)
            base = np.log10(c + 1.0) - floor
            n, spelling = batch.num_rows, 10**lm
            features = np.stack([gated, c + 1.0, spelling], axis=1)
            own = np.flatnonzero(settled)
            sums = np.zeros((n, len(weights)))
            some, starts = np.unique(tokens.doc[own], return_index=True)
            sums[some] = _log_sums(features[own], weights, starts)
            # Training words without their own occurrence; those seen once are new without it and go to the rest.
            trains = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)[tokens.doc] & settled & ~tokens.is_end
            elsewhere, once = np.flatnonzero(trains & (c > 1)), np.flatnonzero(trains & (c == 1))
            fit = np.zeros(2 + len(weights))
            if len(elsewhere):
                less = c[elsewhere] - 1.0
                without = np.stack([gated[elsewhere] * less / c[elsewhere], less + 1.0, spelling[elsewhere]], axis=1)
                fit = np.r_[(spelling[elsewhere] * n_all / c[elsewhere]).sum(), len(elsewhere), _log_sums(without, weights, np.zeros(1, np.int64))[0]]
            offsets_once = np.r_[0, np.cumsum(np.bincount(tokens.doc[once], minlength=n))].astype(np.int32)
            total = lambda values: np.bincount(tokens.doc[settled], weights=values[settled], minlength=n)  # noqa: E731, B023
            rest = np.flatnonzero(~settled)
            offsets = np.r_[0, np.cumsum(np.bincount(tokens.doc[rest], minlength=n))].astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(tokens.keys[tokens.word[rest]]), pa.array(lm[rest].astype(np.float32))], names=["key", "lm"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.bincount(tokens.doc, minlength=n)),
                    pa.array(total((c > 0).astype(float)).astype(np.int64)),
                    pa.array(total(base)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(weights)), pa.array(sums.ravel())),
                    pa.array([fit] + [None] * (n - 1), pa.list_(pa.float64())),
                    pa.ListArray.from_arrays(pa.array(offsets_once), pa.array(lm[once].astype(np.float32))),
                    batch.column(1),
                    pa.ListArray.from_arrays(pa.array(offsets), rare),
                ],
                names=["doc_id", "n_tokens", "known", "base", "mixes", "fit", "once", "trains", "rare"],
            )

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, known long, base double, mixes array<double>, fit array<double>, once array<float>, trains boolean, rare array<struct<key:long,lm:float>>"
    first = stash(rows.select("doc_id", "trains", "text").mapInArrow(scored, schema).withColumn("row", F.monotonically_increasing_id()), "language-scores")
    rare = first.select("row", "trains", F.explode("rare").alias("r")).select("row", "trains", "r.key", F.col("r.lm").alias("lm"))
    joined = stash(rare.join(words.select("key", "n"), "key", "left").select("row", "trains", "lm", "n"), "language-rare")
    rest = joined.where("trains").select("lm", "n").unionByName(first.select(F.explode("once").alias("lm")).withColumn("n", F.lit(1).cast("long")))
    fits = np.zeros(2 + len(weights))
    for r in first.where("fit IS NOT NULL").select(F.posexplode("fit").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect():
        fits[r["at"]] = r["value"]
    chosen = mixture.fit(rest, float(fits[0]), float(fits[1]), fits[2:])
    c = F.coalesce("n", F.lit(0))
    base = F.log10(c + 1.0) - F.lit(floor)
    mix = mixture.of(c, F.lit(False), F.lit(0.0), F.col("lm"))
    more = joined.groupBy("row").agg(F.sum(base).alias("base2"), F.sum(mix).alias("mix2"), F.sum((c > 0).cast("long")).alias("known2"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return first.drop("rare").join(more, "row", "left").select(
        "doc_id",
        (~may_train(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        plus("known", "known2").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        plus("base", "base2").alias("base_score"),
        (F.col("mixes")[chosen] + F.coalesce("mix2", F.lit(0))).alias("score"),
    )
