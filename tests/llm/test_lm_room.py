"""Training and scoring use their large arrays again, and slices are averaged without a frame for each group."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from watchkeep.llm import gru, lm_scoring
from watchkeep.llm.common import prepare

SHAPE = gru.Shape(500, 32)


def new_bytes(work) -> int:
    """The most memory that ``work`` holds beyond what was held before."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_windows_use_their_arrays_again():
    rng = np.random.default_rng(0)
    tokens, fresh = rng.integers(0, 532, 2 * gru.LANES * gru.WINDOW), np.zeros(2 * gru.LANES * gru.WINDOW, bool)
    trainer = gru.Trainer(gru.start(SHAPE, np.ones(500), np.ones(32)), SHAPE, 0.01)
    trainer.train(tokens, fresh)
    assert new_bytes(lambda: trainer.train(tokens, fresh)) < 2_500_000  # the class outputs of one window alone are 1.3 MB, and were held several times


def test_scores_hold_no_outputs_of_all_rows():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 200, 2_000)
    tokens, first = rng.integers(0, 532, lengths.sum()), np.concatenate([[0], np.cumsum(lengths)])
    p = gru.start(SHAPE, np.ones(500), np.ones(32))
    assert new_bytes(lambda: gru.log_likelihood(p, SHAPE, tokens, first)) < 22_000_000


def test_slices_are_weighted_means_over_shares(spark):
    prepare(spark)
    rows = [(i % 7, i % 3, float(i + 1), [float(i), float(i * i % 11)]) for i in range(100)]
    frame = spark.createDataFrame(rows, "part int, share int, weight double, slice array<float>").repartition(5)
    found = {r["part"]: r for r in lm_scoring._averaged(frame).collect()}
    assert sorted(found) == list(range(7))
    for part, r in found.items():
        own = [x for x in rows if x[0] == part]
        np.testing.assert_allclose(r["slice"], np.average([x[3] for x in own], axis=0, weights=[x[2] for x in own]), rtol=1e-6)
        assert r["weight"] == sum(x[2] for x in own)
    plan = lm_scoring._averaged(frame)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    assert lm_scoring._averaged(frame.where(F.lit(False))).count() == 0
