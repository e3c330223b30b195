import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from umbra.llm import language, queries
from umbra.llm.language import CLUSTERS, OWN, STRIDE, WINDOW, Attention, Tokens, windows

PATH = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def _net(seed=1):
    draw = np.random.default_rng(seed)
    classes = OWN + 2 * CLUSTERS + 1
    return Attention(draw.standard_normal((classes, CLUSTERS)).astype(np.float32), draw.standard_normal((2, CLUSTERS)))


def test_gate_agrees_with_forward():
    net, draw = _net(), np.random.default_rng(1)
    inputs = draw.integers(0, len(net.p["E"]), (5, WINDOW))
    counts = draw.random((5, WINDOW)) < 0.7
    net.learn(inputs, draw.random((5, WINDOW, 2 * CLUSTERS)).astype(np.float32), counts.astype(np.float32), np.arange(5), 1e-3, 2)
    want = np.exp(net.forward(inputs)[-1] @ net.p["U"] + net.p["b"])
    want /= want.sum(axis=2, keepdims=True)
    np.testing.assert_allclose(net.gate(inputs, counts), want[counts], atol=2e-5)
    counts[:, :8] = False
    np.testing.assert_allclose(net.gate(inputs, counts, 8), want[counts], atol=2e-5)


def test_gradients_agree_with_differences():
    net, draw = _net(2), np.random.default_rng(2)
    inputs = draw.integers(0, len(net.p["E"]), (3, WINDOW))
    shares = draw.random((3, WINDOW, 2 * CLUSTERS))
    counts = (draw.random((3, WINDOW)) < 0.6).astype(np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        y = np.exp(net.forward(inputs)[-1] @ net.p["U"] + net.p["b"])
        y /= y.sum(axis=2, keepdims=True)
        return -(np.log((y * shares).sum(axis=2)) * counts).sum() / counts.sum()

    grads = net.gradients(inputs, shares, counts)
    for key, value in net.p.items():
        for _ in range(4):
            at = tuple(draw.integers(0, n) for n in value.shape)
            if key == "E":
                at = (int(inputs[0, 0]), at[1])
            kept = value[at]
            value[at] = kept + 1e-4
            up = loss()
            value[at] = kept - 1e-4
            down = loss()
            value[at] = kept
            assert (up - down) / 2e-4 == pytest.approx(float(grads[key][at]), abs=2e-5)


def test_a_later_subword_never_changes_an_earlier_gate():
    net, draw = _net(3), np.random.default_rng(3)
    inputs = draw.integers(0, len(net.p["E"]), (1, WINDOW))
    other = inputs.copy()
    other[0, 20:] = 0
    every = np.ones((1, WINDOW), bool)
    np.testing.assert_allclose(net.gate(inputs, every)[:20], net.gate(other, every)[:20], atol=1e-6)


def test_every_token_is_scored_once():
    place, counts = windows(np.repeat([0, 1, 2, 3], [1, WINDOW, WINDOW + 1, 200]))
    assert sorted(place[counts].tolist()) == list(range(1 + WINDOW + WINDOW + 1 + 200))
    assert int(np.flatnonzero(windows(np.zeros(WINDOW + 1, np.int64))[1][1])[0]) == WINDOW - STRIDE == 8


def test_words_and_subwords_of_a_text():
    look_up = language.words_of(PATH)
    tokens = Tokens([b"the cat \xc3\xbcber the".split(), []], look_up)
    ids = [i for w in (" the", " cat", " über", " the") for i in look_up.encode(w)]
    assert tokens.ids.tolist() == [*ids, look_up.end, look_up.end]
    assert tokens.is_end.tolist() == [False] * 4 + [True, True]
    assert tokens.word[0] == tokens.word[3]


def _corpus(spark):
    draw = random.Random(3)
    kinds = [["alpha", "beta", "gamma"], ["uno", "dos", "tres"], ["eins", "zwei", "drei"]]
    rows = [(i, " ".join(draw.choice(kinds[i % 3]) if draw.random() < 0.8 else f"w{draw.randrange(2000)}" for _ in range(draw.randrange(1, 90)))) for i in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_counts_of_all_training_documents_and_a_gain_on_held_out_ones(spark):
    _, docs = _corpus(spark)
    found = language.score_language(docs, PATH).toPandas()
    held = found[found.held_out]
    assert len(found) == 900 and 80 < len(held) < 180
    assert np.isfinite(found.score).all() and (found.score < 0).all()
    assert (held.score > held.base_score).mean() > 0.9
    training = docs.where(language.may_train(F.col("doc_id"))).agg(F.sum(F.size(F.split("text", " ")) + 1)).first()[0]
    assert (found.train_tokens == training).all()


def test_words_beyond_the_head_meet_their_counts(spark, monkeypatch):
    _, docs = _corpus(spark)
    want = language.score_language(docs, PATH).orderBy("doc_id").toPandas()
    monkeypatch.setattr(language, "HEAD", 5)
    got = language.score_language(docs, PATH).orderBy("doc_id").toPandas()
    assert (got.n_known == want.n_known).all()
    np.testing.assert_allclose(got.base_score, want.base_score)
    assert np.isfinite(got.score).all()


def test_training_segments_come_from_every_document():
    import pyarrow as pa

    for text in ["", "żółć", "ż" * 5000, *(" ".join(f"wé{i}" for i in range(n)) for n in (1, 23, 24, 25, 2000, 20000))]:
        found = language._segments(pa.array([text.encode()])[0])
        n = max(1, -(-len(text.encode()) // language.SEGMENT))
        assert 1 <= len(found) <= -(-n // language.SHARE)
        whole = set(text.encode().split())
        assert all(word in whole for segment in found for word in segment)
    assert sum(map(len, found)) > 1000


def test_edge_cases(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z"), (3, "word " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = language.score_language(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 3), (1, 1), (2, 1), (2, 1), (3, 9001)]
    assert all(np.isfinite(r.score) for r in found)
    assert language.score_language(docs.limit(0), PATH).count() == 0
    assert language.score_language(docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"), PATH).count() == 5


def test_held_out_documents_of_the_tables_gain(spark):
    found = queries.op7_language_model(spark, "/root/testdata/sf0.001").toPandas()
    held = found[found.held_out]
    assert (held.score > held.base_score).mean() > 0.5 and held.score.sum() > held.base_score.sum()


def test_sums_of_logarithms_by_part():
    draw = np.random.default_rng(4)
    features, weights = draw.random((5000, 3)) * 1e-9, draw.random((7, 3))
    starts = np.r_[0, np.sort(draw.choice(np.arange(1, 5000), 60, replace=False))]
    want = np.add.reduceat(np.log10(features @ weights.T), starts, axis=0)
    np.testing.assert_allclose(language._log_sums(features, weights, starts), want)
    np.testing.assert_allclose(language._log_sums(features[:1200 * 16], weights, np.zeros(1, np.int64))[0], np.log10(features @ weights.T).sum(axis=0))


def test_weights_are_fitted_without_a_row_for_each_word(spark, monkeypatch):
    _, docs = _corpus(spark)
    written, fitted, whole, fit = {}, [], language.stash, language.Mixture.fit

    def stash(df, tag):
        made = whole(df, tag)
        written[tag] = made.count()
        return made

    def watched(self, rest, *args):
        # Head words that training has twice or more come as sums, those it has once as rows, all others by the join.
        fitted.append((rest.count(), args[1] if len(args) == 3 else 0))
        return fit(self, rest, *args)

    monkeypatch.setattr(language, "stash", stash)
    monkeypatch.setattr(language.Mixture, "fit", watched)
    language.score_language(docs, PATH).count()
    inner = docs.where(language.may_train(F.col("doc_id"))).select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").count()
    total, once = inner.agg(F.sum("count"), F.count(F.when(F.col("count") == 1, 1))).first()
    assert fitted == [(once, total - once)]
    assert max(n for tag, n in written.items() if tag not in ("language-segments", "language-counts", "language-words")) <= 900
