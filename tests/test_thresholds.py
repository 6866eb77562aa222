import random
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.loops import threshold_loop
from watchkeep.operators.thresholds import (
    Threshold, ThresholdRun, dense, distinct_counts, nth_new, previous_places, threshold_firings)


def firing_ids(rule, pairs, cuts):
    """Run the fold in pieces, as Arrow batches or micro-batches would."""
    run, fired, start = ThresholdRun(rule), [], 0
    for stop in [*cuts, len(pairs)]:
        piece = pairs[start:stop]
        times = np.array([t for t, _ in piece], dtype=np.int64)
        values = [v for _, v in piece] if rule.distinct else None
        fired += [start + i for i in run.advance(times, values)]
        start = stop
    return fired


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_any_cut_of_one_key_equals_the_loop(data):
    count = data.draw(st.integers(1, 6))
    distinct = data.draw(st.booleans())
    steps = data.draw(st.lists(st.tuples(st.sampled_from([0, 1, 2, 5]), st.integers(0, 7)), max_size=60))
    cuts = sorted(data.draw(st.lists(st.integers(0, len(steps)), max_size=5)))
    rule, now, pairs = Threshold(count, 10, distinct), 0, []
    for step, value in steps:
        now += step * 1_000_000
        pairs.append((now, value))
    rows = [("k", t, i, v) for i, (t, v) in enumerate(pairs)]
    assert firing_ids(rule, pairs, cuts) == threshold_loop(rows, count, rule.micros, distinct)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_moves_of_every_phase_compose(data):
    """Exploring all phases over a middle piece agrees with running through."""
    distinct = data.draw(st.booleans())
    rule = Threshold(data.draw(st.integers(1, 5)), 10, distinct)
    pairs, now = [], 0
    for step, value in data.draw(st.lists(st.tuples(st.sampled_from([0, 1, 3]), st.integers(0, 6)), min_size=3, max_size=50)):
        now += step * 1_000_000
        pairs.append((now, value))
    a, b = sorted([data.draw(st.integers(0, len(pairs))), data.draw(st.integers(0, len(pairs)))])

    def feed(run, piece):
        run.advance(np.array([t for t, _ in piece], dtype=np.int64), [v for _, v in piece] if distinct else None)
        return run

    head = feed(ThresholdRun(rule), pairs[:a])
    middle = feed(ThresholdRun(rule, head.recent, range(len(head.recent) + 1)), pairs[a:b])
    through = feed(ThresholdRun(rule), pairs[:b])
    assert middle.moves()[head.phase()] == through.phase()
    assert [t for _, t in middle.recent] == [t for _, t in through.recent]


def test_gap_of_exactly_the_window_is_purged():
    rule = Threshold(2, 10)
    at = lambda *seconds: [(s * 1_000_000, None) for s in seconds]
    assert firing_ids(rule, at(0, 10), []) == []
    assert firing_ids(rule, [(0, None), (9_999_999, None)], []) == [1]


@pytest.mark.parametrize("partitions", [1, 2, 7])
@pytest.mark.parametrize("batch", ["10000", "13"])
def test_hot_keys_spread_over_chunks(spark, partitions, batch):
    rng = random.Random(partitions)
    rules = {"a": Threshold(5, 20), "b": Threshold(4, 30, distinct=True), "flood": Threshold(3, 1000)}
    rows, now = [], 0
    for i in range(1500):
        now += rng.choice([0, 1, 1, 3, 40]) * 1_000_000
        rule = rng.choice(list(rules))
        key = "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}"
        rows.append((i, rule, key, now, rng.randint(0, 6)))
    df = spark.createDataFrame(rows, "id long, rule string, key string, us long, port int")
    df = df.withColumn("at", F.timestamp_micros("us")).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = threshold_firings(df, rules, "rule", "key", "at", "id", "port", partitions)
        got = sorted((r.rule, r.id) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = []
    for name, rule in rules.items():
        mine = [(key, us, i, port) for i, r, key, us, port in rows if r == name]
        want += [(name, i) for i in threshold_loop(mine, rule.count, rule.micros, rule.distinct)]
    assert got == sorted(want)


def test_only_dense_buckets_are_kept(spark):
    rules = {"n": Threshold(3, 10), "d": Threshold(3, 10, distinct=True)}
    times = [(1, "busy", 8), (2, "busy", 11), (3, "busy", 12), (4, "busy", 45), (5, "calm", 1), (6, "calm", 12), (7, None, 1)]
    rows = [(i, rule, key, t, 1) for rule in rules for i, key, t in times] + [(8, "n", "busy", None, 1)]
    df = spark.createDataFrame(rows, "id long, rule string, key string, s long, port int").withColumn("at", F.timestamp_seconds("s"))
    assert sorted(r.id for r in dense(df, rules, "rule", "key", "at", "port").collect()) == [1, 2, 3]
    assert [r.id for r in threshold_firings(df, rules, "rule", "key", "at", "id", "port").collect()] == [3]


def test_colons_in_rules_and_keys_keep_apart(spark):
    rules = {"a": Threshold(2, 10), "a:b": Threshold(3, 10)}
    rows = [(1, "a", "b:x", 1), (2, "a", "b:x", 2), (3, "a:b", "x", 1), (4, "a:b", "x", 2)]
    df = spark.createDataFrame(rows, "id long, rule string, key string, s long").withColumn("at", F.timestamp_seconds("s"))
    assert [r.id for r in threshold_firings(df, rules, "rule", "key", "at", "id").collect()] == [2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=80), st.integers(1, 8), st.integers(1, 12))
def test_distinct_counts_and_places_equal_loops(codes, count, width):
    codes = np.array(codes)
    earlier, last = previous_places(codes)
    assert last.tolist() == sorted({c: i for i, c in enumerate(codes.tolist())}.values())
    first = np.maximum(np.arange(len(codes)) - width + 1, 0)
    assert distinct_counts(earlier, first).tolist() == [len(set(codes[f: i + 1].tolist())) for i, f in enumerate(first)]
    for start in range(len(codes) + 1):
        enough = [i for i in range(start, len(codes)) if len(set(codes[start: i + 1].tolist())) >= count]
        assert nth_new(earlier, start, count) == min(enough, default=len(codes))


def test_many_rows_of_one_key_take_few_steps():
    """Half a million sightings of 30,000 values, most of them inside a full window."""
    rng = np.random.default_rng(2)
    times, values = np.cumsum(rng.integers(0, 3, 500_000)) * 100_000, rng.integers(0, 30_000, 500_000)
    rule = Threshold(20, 60, True)
    run, started = ThresholdRun(rule), time.perf_counter()
    fired = run.advance(times, values.tolist())
    assert time.perf_counter() - started < 10
    rows = [("k", t, i, v) for i, (t, v) in enumerate(zip(times[:5000].tolist(), values[:5000].tolist()))]
    assert [f for f in fired if f < 5000] == threshold_loop(rows, 20, rule.micros, True)
