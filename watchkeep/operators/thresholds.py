"""Count and distinct-value thresholds that reset when they fire.

Per key, the qualifying rows of the last W seconds (strictly younger than W)
since the previous firing are kept.  When they number N rows, or N distinct
values, the row fires and the kept rows are forgotten.

A row is *full* if its window holds N, whatever fired before.  The next firing
is the first full row from the place on at which N have been seen since the last
one, because the kept rows are the shorter of both stretches.  Everything needed
from the past is therefore the N - 1 most recently seen values and how many of
them came after the previous firing: that number is the phase, 0 to N - 1.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from watchkeep.operators.ordered_fold import KEY, Fold, ordered_fold
from watchkeep.session import materialise

TIME, ORDER_ID, VALUE, ROW = "fold_time", "fold_id", "fold_value", "fold_row"
MOST_BROADCAST = 1_000_000  # numbers of firing rows


@dataclass(frozen=True)
class Threshold:
    """Fire at ``count`` rows, or distinct values, within ``seconds``."""

    count: int
    seconds: int
    distinct: bool = False

    @property
    def micros(self) -> int:
        return self.seconds * 1_000_000


class ThresholdRun:
    """Position within one key: recent sightings and one phase per start."""

    def __init__(self, rule: Threshold, recent=(), phases=(0,)):
        self.rule = rule
        self.recent = list(recent)  # (value, micros), newest first, at most count - 1
        self.phases = list(phases)

    def phase(self) -> int:
        return self.phases[0]

    def moves(self) -> list[int]:
        return self.phases

    def advance(self, times: np.ndarray, values: pa.Array | list | None) -> list[int]:
        """Consume rows in order; return the firing positions of the first start."""
        if not len(times):
            return []
        sightings = self._sightings_counted if values is None else self._sightings_distinct
        rows, reached, recent = sightings(times, values)
        rows = rows.tolist()
        fired, ended = [], {}
        for which, phase in enumerate(self.phases):
            last, path = -(phase + 1), []
            at = bisect_left(rows, reached(last))
            while at < len(rows) and at not in ended:
                path.append(at)
                last = rows[at]
                at = bisect_left(rows, reached(last))
            if at in ended:
                last = ended[at]
            ended.update((step, last) for step in path)
            if which == 0:
                fired = [rows[step] for step in path]
            self.phases[which] = sum(1 for position, _, _ in recent if position > last)
        self.recent = [(value, micros) for _, value, micros in recent]
        return fired

    def _sightings_counted(self, times, values):
        """Every row counts as a new value."""
        count, before = self.rule.count, len(self.recent)
        seen = np.concatenate([np.array([t for _, t in reversed(self.recent)], dtype=np.int64), times])
        old = np.arange(len(times), dtype=np.int64) - (count - 1) + before
        inside = np.zeros(len(times), dtype=bool)
        known = old >= 0
        inside[known] = times[known] - seen[old[known]] < self.rule.micros
        newest = range(len(seen) - 1, max(len(seen) - count, -1), -1)
        recent = [(place - before, None, int(seen[place])) for place in newest]
        return np.flatnonzero(inside), lambda last: last + count, recent

    def _sightings_distinct(self, times, values):
        count, before = self.rule.count, len(self.recent)
        seen = np.concatenate([np.array([t for _, t in reversed(self.recent)], dtype=np.int64), times])
        values = values if isinstance(values, pa.Array) else pa.array(values)
        known = pa.concat_arrays([pa.array([v for v, _ in reversed(self.recent)], values.type), values])
        encoded = known.dictionary_encode(null_encoding="encode")
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        earlier, last_places = previous_places(codes)
        # Times do not fall, so the window's first place does not either.
        first = np.searchsorted(seen, seen - self.rule.micros, side="right")
        rows = np.flatnonzero(distinct_counts(earlier, first)[before:] >= count)
        newest = last_places[::-1][: count - 1]
        names = encoded.dictionary.take(pa.array(codes[newest])).to_pylist()
        recent = [(int(place) - before, name, int(seen[place])) for place, name in zip(newest, names)]
        return rows, lambda last: nth_new(earlier, last + before + 1, count) - before, recent


def previous_places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the previous one of its value, or -1; and the last place of every value, ascending."""
    order = np.argsort(codes, kind="stable")
    again = codes[order][1:] == codes[order][:-1]
    earlier = np.full(len(codes), -1, dtype=np.int64)
    earlier[order[1:][again]] = order[:-1][again]
    is_last = np.ones(len(codes), dtype=bool)
    is_last[:-1] = ~again
    return earlier, np.sort(order[is_last[: len(order)]])


def distinct_counts(earlier: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many values occur at places first[i] to i; ``first`` does not fall.

    A place q counts for i from q on, where first[i] lies after q's previous
    place and not after q: one stretch of i, so its ends are counted and summed.
    """
    places = np.arange(len(earlier))
    begin = np.maximum(places, np.searchsorted(first, earlier, side="right"))
    end = np.searchsorted(first, places, side="right")
    some = begin < end
    size = len(places) + 1
    return np.cumsum(np.bincount(begin[some], minlength=size) - np.bincount(end[some], minlength=size))[:-1]


def nth_new(earlier: np.ndarray, start: int, count: int) -> int:
    """The place at which ``count`` values have occurred from ``start`` on; past the end if there are fewer."""
    found, at, width = 0, start, 4 * count
    while at < len(earlier):
        new = np.flatnonzero(earlier[at: at + width] < start)
        if found + len(new) >= count:
            return at + int(new[count - found - 1])
        found, at, width = found + len(new), at + width, 2 * width
    return len(earlier)


class ThresholdFold(Fold):
    """Keys read ``length:rule:...``; rules are looked up by name, which may hold colons."""

    def __init__(self, rules: dict[str, Threshold], columns: list[str]):
        self.rules = rules
        self.columns = columns

    def _rule(self, key: str) -> Threshold:
        length, _, rest = key.partition(":")
        return self.rules[rest[: int(length)]]

    def fresh(self, batch, row):
        return ThresholdRun(self._rule(batch.column(batch.schema.get_field_index(KEY))[row].as_py()))

    def resume(self, key, context, phase):
        return ThresholdRun(self._rule(key), context, [phase])

    def explore(self, key, context):
        return ThresholdRun(self._rule(key), context, range(len(context) + 1))

    def advance(self, run, batch, start, stop):
        def column(name):
            return batch.column(batch.schema.get_field_index(name)).slice(start, stop - start)

        times = column(TIME).to_numpy(zero_copy_only=False)
        fired = run.advance(times, column(VALUE) if run.rule.distinct else None)
        return fired or None

    def emit(self, batch, outputs):
        rows = [start + place for start, _, fired in outputs for place in fired]
        if not rows:
            return None
        keep = [batch.schema.get_field_index(name) for name in self.columns]
        return pa.RecordBatch.from_arrays([batch.column(i) for i in keep], names=self.columns).take(pa.array(rows))

    def context(self, run):
        return run.recent

    def merge(self, key, context, before):
        if context and context[0][0] is None:
            seen = list(context) + list(before)
        else:
            values = {value for value, _ in context}
            seen = list(context) + [pair for pair in before if pair[0] not in values]
        return seen[: self._rule(key).count - 1]

    def context_size(self):
        return max(rule.count for rule in self.rules.values())

    def idle(self, key, rows):
        return rows < self._rule(key).count


def dense(rows: DataFrame, rules: dict[str, Threshold], rule: str, key: str, time: str, value: str | None = None) -> DataFrame:
    """The rows that can take part in a firing: those in buckets that reach the threshold together with a neighbour.

    Buckets are as long as the window, so a window lies in two neighbours.  If
    these hold fewer rows, or distinct values, than the threshold, none of their
    windows fires, and rows in no such pair change nothing.  Counts combine
    before the shuffle; rows are found by (rule, key, bucket), so a hot key is
    spread over its buckets, and adaptive execution splits a hot bucket.  Rows without a key or a time are in no bucket.
    """
    of = lambda pick: F.coalesce(*[F.when(F.col("r") == n, F.lit(pick(t))) for n, t in rules.items()])
    width = F.coalesce(*[F.when(F.col(rule) == n, F.lit(t.micros)) for n, t in rules.items()])
    bucket = F.floor(F.unix_micros(F.col(time)) / width)
    named = rows.select(
        F.col(rule).alias("r"), F.col(key).alias("k"), bucket.alias("b"),
        (F.col(value).cast("string") if value else F.lit(None).cast("string")).alias("v"))
    sightings = named.groupBy("r", "k", "b", F.when(of(lambda t: t.distinct), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    counted = sightings.groupBy("r", "k", "b").agg(F.sum(F.when(of(lambda t: t.distinct), 1).otherwise(F.col("n"))).alias("n"))
    # A pair is named by its later bucket.
    pairs = counted.select("r", "k", "n", F.explode(F.array("b", F.col("b") + 1)).alias("p"))
    full = pairs.groupBy("r", "k", "p").agg(F.sum("n").alias("n")).where(F.col("n") >= of(lambda t: t.count))
    # Stored, so that the join with it can be split where a bucket has very many rows.
    wanted = materialise(full.select("r", "k", F.explode(F.array(F.col("p") - 1, F.col("p"))).alias("b")).distinct())
    found = rows.withColumn("fold_bucket", bucket)
    same = (found[rule] == wanted["r"]) & (found[key] == wanted["k"]) & (found["fold_bucket"] == wanted["b"])
    return found.join(wanted, same, "left_semi").drop("fold_bucket")


def threshold_firings(
    rows: DataFrame,
    rules: dict[str, Threshold],
    rule: str,
    key: str,
    time: str,
    order_id: str,
    value: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """The rows that fire, unchanged.

    ``rows`` holds the qualifying rows of all ``rules``: column ``rule`` names
    the rule, ``key`` the group, ``value`` the counted value of distinct rules.
    They are numbered and stored once.  What is sorted are their numbers, keys,
    times, ids and values, of dense buckets only, in one shuffle for all rules;
    the rows that fire are then found by number.  Rows without a key or a time
    never fire.
    """
    numbered = materialise(rows.withColumn(ROW, F.monotonically_increasing_id()))
    narrow = numbered.select(
        ROW, F.col(rule).alias("rule"), F.col(key).alias("key"), F.col(time).alias("time"), F.col(order_id).alias(ORDER_ID),
        (F.col(value).cast("string") if value else F.lit(None).cast("string")).alias(VALUE))
    prepared = (
        dense(narrow, rules, "rule", "key", "time", VALUE)
        .withColumn(KEY, F.concat(F.length("rule"), F.lit(":"), F.col("rule"), F.lit(":"), F.col("key")))
        .withColumn(TIME, F.unix_micros("time"))
        .select(ROW, KEY, TIME, ORDER_ID, VALUE)
    )
    schema = StructType([StructField(ROW, LongType())])
    fired = materialise(ordered_fold(prepared, ThresholdFold(rules, [ROW]), [TIME, ORDER_ID], schema, partitions))
    if fired.count() <= MOST_BROADCAST:
        fired = F.broadcast(fired)
    return numbered.join(fired, ROW, "left_semi").drop(ROW)
