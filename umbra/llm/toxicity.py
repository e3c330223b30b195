"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.batches import pieces, small_batches
from umbra.shared import stash, within

#: Labelled rows that the label model and the classifier are fitted on at most (a share of the ids by digest), lexicon
#: entries that vote at most, and rows of labelled documents with an entry that it needs.
MOST_TRAINING, MOST_VOTERS, LEAST_ROWS = 20_000, 384, 3
#: How often an entry is as frequent in toxic rows as in others, at least, to become a voter.
LEAST_LIFT = 6.0
#: Lengths (bytes) of the word beginnings that serve as stem patterns beside whole words.
STEMS = (4, 5, 6)

_BREAKS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def entries(text: str) -> Counter:
    """Occurrences of lower-cased words (``=word``) and of their beginnings (``word*``)."""
    found: Counter = Counter()
    for word, n in Counter(text.lower().encode("utf-8", "replace").translate(_BREAKS).split()).items():
        found[b"=" + word] += n
        for size in STEMS:
            if len(word) > size:
                found[word[:size] + b"*"] += n
    return found


def may_train(id_col: Column) -> Column:
    """Rows that labels may be learned from."""
    return F.crc32(id_col.cast("string")) % 3 != 1


class LabelModel:
    """Two-class generative model of binary voters: class share, each voter's two rates, correlations.

    Expectation-maximisation from the share of rows in which any voter fires. Voters whose residuals within the
    classes stay correlated say the same thing: each vote counts by one over the correlated mass of its voter.
    """

    def __init__(self, rounds: int = 25):
        self.rounds = rounds

    def fit(self, votes: np.ndarray, prior: np.ndarray) -> LabelModel:
        """votes: rows x voters in {0, 1}; prior: a first guess of each row's probability."""
        votes = votes.astype(np.float32)
        posterior = prior.astype(np.float32)
        self.weights = np.ones(votes.shape[1], np.float32)
        for turn in range(self.rounds):
            share = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
            self.bias = float(np.log(share / (1 - share)))
            self.hit = (posterior @ votes + 0.5) / (posterior.sum() + 1)
            self.false = ((1 - posterior) @ votes + 0.05) / ((1 - posterior).sum() + 1)
            if turn >= 2:
                self.weights = self._independence(votes, posterior)
            posterior = self.posterior(votes)
        return self

    def _independence(self, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        mass = np.zeros((votes.shape[1],) * 2, np.float32)
        for part, rates in ((posterior, self.hit), (1 - posterior, self.false)):
            rest = (votes - rates) * np.sqrt(part)[:, None]
            mass += rest.T @ rest
        spread = np.sqrt(np.maximum(np.diag(mass), 1e-9))
        self.correlation = mass / spread[:, None] / spread[None, :]
        return 1 / np.maximum(1, np.where(self.correlation > 0.2, self.correlation, 0).sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        present = np.log(self.hit / self.false) * self.weights
        absent = np.log((1 - self.hit) / (1 - self.false)) * self.weights
        score = self.bias + votes @ present + (1 - votes) @ absent
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def logistic(features: np.ndarray, target: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier on soft targets, by accelerated gradient descent."""
    x, y = features.astype(np.float32), target.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    step = 4.0 / (1 + float((x**2).sum(axis=1).mean()))
    seen, last = w.copy(), w.copy()
    for turn in range(rounds):
        ahead = seen + (turn / (turn + 3)) * (seen - last)
        error = 1 / (1 + np.exp(-np.clip(x @ ahead + b, -30, 30))) - y
        last, seen = seen, ahead - step * (x.T @ error / len(y) + l2 * ahead)
        b -= step * float(error.mean())
    return seen, b


def _features(found: Counter, place: dict[bytes, int]) -> list[int]:
    return [place[e] for e in found.keys() & place.keys()]


def _shape(rows: list[list[int]], totals: list[int], width: int) -> np.ndarray:
    """Presence of each voter's entry and, as two pattern voters, two or more and four or more different entries."""
    out = np.zeros((len(rows), width + 2), np.float32)
    for i, row in enumerate(rows):
        out[i, row] = 1
        out[i, width] = len(row) >= 2
        out[i, width + 1] = len(row) >= 4
    return out


def _lexicon(training: DataFrame) -> list[bytes]:
    """Entries by lift and coverage over all rows that may train; counts are added up inside tasks first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, bad = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (bad if toxic else good).update(entries(text or "").keys())
            names = list(good.keys() | bad.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([bad[n] for n in names], pa.int64()), pa.array([good[n] for n in names], pa.int64())],
                names=["entry", "bad", "good"],
            )

    totals = training.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("rows")).first()
    n_bad, n_good = totals["bad"], totals["rows"] - totals["bad"]
    if not n_bad or not n_good:
        return []
    counts = training.mapInArrow(counted, "entry binary, bad long, good long")
    counts = counts.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lift = (F.col("bad") / F.lit(float(n_bad))) / ((F.col("good") + 0.5) / F.lit(float(n_good)))
    best = counts.where((F.col("bad") >= LEAST_ROWS) & (lift >= LEAST_LIFT)).orderBy(F.col("bad").desc(), "good", "entry")
    return [bytes(r["entry"]) for r in best.limit(MOST_VOTERS).collect()]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TRAINING):
    """The lexicon's places and the classifier's weights. Only features of at most ``most`` rows reach the driver."""
    marks = labels.select(F.col(id_col).alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(may_train(F.col("label_id")) & F.col("toxic").isNotNull()).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = within(marks)
    training = stash(texts.join(marks, texts["doc_id"] == marks["label_id"]).select("doc_id", "text", "toxic"), "toxicity")
    place = {entry: i for i, entry in enumerate(_lexicon(training))}
    if not place:
        return place, np.zeros(2, np.float32), -3.0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_features(entries(text or ""), place) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], names=["found", "toxic"])

    rows = training.count()
    share = F.lit(min(1.0, 0.95 * most / rows) * float(1 << 31))
    sample = (training if rows <= most else training.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < share)).select("text", "toxic")
    table = sample.mapInArrow(read, "found array<int>, toxic int").toPandas()
    votes = _shape([list(r) for r in table["found"]], [], len(place))
    toxic = table["toxic"].to_numpy()
    fired = votes.any(axis=1)
    guess = np.where(fired, max(toxic[fired].mean() if fired.any() else 0, 0.05), toxic[~fired].mean() if (~fired).any() else 0.01)
    model = LabelModel().fit(votes, guess)
    weights, bias = logistic(votes, model.posterior(votes))
    # The classifier's scale comes from posterior labels; the marked rows only shift and stretch it.
    raw = votes @ weights + bias
    a, c = _calibrate(raw, toxic)
    return place, weights * a, bias * a + c


def _calibrate(raw: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    slope, shift = logistic((raw[:, None] - raw.mean()) / (raw.std() + 1e-6), toxic, rounds=500, l2=1e-5)
    slope = max(float(slope[0]), 1e-3) / (raw.std() + 1e-6)
    return slope, shift - slope * float(raw.mean())


def score_toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document (and the columns in ``keep``).

    The lexicon is chosen by counts over all labelled rows that may train; the label model weighs its voters by
    their agreement, and the linear classifier learns the label model's posteriors on at most ``MOST_TRAINING``
    rows. Scores come from the whole text alone.

    Null and empty texts score as texts in which no voter fires. Labels repeated for an id count once, the larger
    wins; null labels are ignored; without labels of both kinds every score is the bias alone. Repeated documents
    are scored each time. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    place, weights, bias = train(docs, labels, id_col, text_col)
    width = len(place)
    types = dict(docs.dtypes)
    keep = keep or []
    schema = ", ".join([f"doc_id {types[id_col]}", "score double", *(f"`kept_{i}` {types[k]}" for i, k in enumerate(keep))])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            values = []
            for text in batch.column(1):
                row = _features(entries(text.as_py() or ""), place)
                total = bias + float(weights[row].sum(dtype=np.float64)) + float(weights[width]) * (len(row) >= 2) + float(weights[width + 1]) * (len(row) >= 4)
                values.append(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.float64()), *batch.columns[2:]], names=["doc_id", "score", *(f"kept_{i}" for i in range(len(keep)))]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(k).alias(f"kept_{i}") for i, k in enumerate(keep)))
    out = rows.mapInArrow(scored, schema)
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *(F.col(f"kept_{i}").alias(k) for i, k in enumerate(keep)),
    )
