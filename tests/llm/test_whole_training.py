"""The language model learns from every training document, to its last token."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchkeep.llm import gru, lm_scoring
from watchkeep.llm.common import prepare


def test_every_training_token_is_learned_from_once(spark, monkeypatch):
    seen, averaged = [], lm_scoring._averaged

    def counted(rows):
        seen.append(rows.where("part = 0").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0])
        return averaged(rows)

    monkeypatch.setattr(lm_scoring, "_averaged", counted)
    rng = random.Random(1)
    rows = [(i if i % 3 else None, " ".join(rng.choices(["red", "green", "blue", "grey"], k=30))) for i in range(240)]
    prepare(spark)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lm_scoring.log_scores(frame, known=10, heads=4).collect()
    assert sum(seen) == found[0]["train_tokens"] and min(seen) > 0


def test_equal_and_missing_ids_are_dealt_over_all_turns(spark):
    prepare(spark)
    frame = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    found = lm_scoring.dealt(frame, 4).collect()
    assert sorted(int(r["text"]) for r in found) == list(range(400))
    assert {r["turn"] for r in found} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        lm_scoring.train(None, None, 2, 3, 0.01)


def test_the_last_tokens_are_trained_on():
    shape = gru.Shape(100, 8, 16)
    tokens = np.random.default_rng(0).integers(0, 108, 4 * gru.WINDOW + 2)
    fresh = np.zeros(len(tokens), bool)
    fresh[0] = True
    learned = []
    for last in (3, 50):
        trainer = gru.Trainer(gru.start(shape, np.ones(100), np.ones(8)), shape, 0.01)
        trainer.train(np.append(tokens[:-1], last), fresh)
        assert trainer.seen == len(tokens)
        learned.append(gru.flatten(trainer.p))
    assert np.abs(learned[0] - learned[1]).max() > 0


def plain_log_likelihood(p, shape, tokens):
    """One sequence, one token at a time, all outputs spelt out."""
    sigmoid, size, out = lambda x: 1 / (1 + np.exp(-x)), gru.HIDDEN, 0.0
    h = np.zeros(size)
    for token in tokens:
        of_class = np.exp(h @ p["C"] + p["bc"])
        place = token // shape.size if token < shape.heads else shape.head_classes + token - shape.heads
        out += np.log(of_class[place] / of_class.sum())
        if token < shape.heads:
            members = slice(place * shape.size, (place + 1) * shape.size)
            inside = np.exp(p["W"][members] @ h + p["bw"][members])
            out += np.log(inside[token - members.start] / inside.sum())
        x, a = p["E"][token] @ p["X"] + p["bx"], h @ p["R"]
        z, r = sigmoid(x[:size] + a[:size]), sigmoid(x[size: 2 * size] + a[size: 2 * size])
        h = (1 - z) * np.tanh(x[2 * size:] + r * a[2 * size:]) + z * h
    return out


def model():
    shape, rng = gru.Shape(100, 8, 16), np.random.default_rng(3)
    p = gru.start(shape, rng.integers(1, 50, 100).astype(float), np.ones(8))
    return shape, {k: v.astype(np.float64) + (k not in ("bw",)) * rng.normal(0, 0.3, v.shape) for k, v in p.items()}


@pytest.mark.parametrize("rows", [1, 50, 65_536])
def test_scores_equal_a_plain_network(monkeypatch, rows):
    monkeypatch.setattr(gru, "SCORE_ROWS", rows)
    shape, p = model()
    rng = np.random.default_rng(1)
    lengths = [0, 1, 700, 3, 90, 90, 0, 2]
    texts = [rng.integers(0, 108, n) for n in lengths]
    found = gru.log_likelihood(p, shape, np.concatenate(texts), np.concatenate([[0], np.cumsum(lengths)]))
    np.testing.assert_allclose(found, [plain_log_likelihood(p, shape, t) for t in texts], rtol=1e-9)


def test_probabilities_of_all_words_sum_to_one():
    shape, p = model()
    opening = [5, 104, 99, 17]
    ends = [np.array([*opening, w]) for w in range(108)]
    scores = gru.log_likelihood(p, shape, np.concatenate(ends), np.arange(0, 5 * 109, 5))
    before = gru.log_likelihood(p, shape, np.array(opening), np.array([0, 4]))[0]
    assert np.exp(scores - before).sum() == pytest.approx(1)


def test_look_up_finds_what_is_held():
    rng = np.random.default_rng(4)
    v = object.__new__(lm_scoring.Vocabulary)
    v.shape = gru.Shape(50, lm_scoring.TAILS)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 3000).astype(np.uint64), np.arange(40, dtype=np.uint64) + np.uint64((1 << 64) - 40)]))
    v.index(hashes, rng.permutation(len(hashes)), np.arange(1, len(hashes) + 1), np.zeros(len(hashes), np.int64))
    asked = np.concatenate([hashes, hashes + np.uint64(1), [np.uint64(0)]])
    token, n = v.look_up(asked, np.zeros(len(asked), np.int64))
    place = {int(h): i for i, h in enumerate(v.hashes)}
    assert n.tolist() == [int(v.n[place[int(h)]]) if int(h) in place else 0 for h in asked]
    assert token.tolist() == [int(v.rank[place[int(h)]]) if int(h) in place and v.rank[place[int(h)]] < 50 else 50 for h in asked]
