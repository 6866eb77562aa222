"""Running sums over sorted rows, for keys of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from watchkeep.llm.common import store


def _segments(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _before(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, carried: np.int64, xor: bool) -> tuple[np.ndarray, np.int64]:
    """What precedes each value in its run, and the whole of the last run."""
    add = np.bitwise_xor if xor else np.add
    less = np.bitwise_xor if xor else np.subtract
    total = add.accumulate(values)
    ahead = less(total, values)
    ahead = less(ahead, np.repeat(ahead[starts], lengths))
    ahead[: lengths[0]] = add(ahead[: lengths[0]], carried)
    return ahead, add(ahead[-1], values[-1])


def running(df: DataFrame, key: str, order: list[str], sums: list[str] = (), xors: list[str] = (), name: str = "running") -> DataFrame:
    """``df`` with ``<column>_before``: sum (or exclusive or) of a column over the earlier rows of its key.

    ``key`` and the summed columns are longs without nulls.  Rows are sorted
    into ranges of (key, order), so a key with most rows is spread over many
    tasks; every task sums its own rows and ends with one row that says what its
    last key has come to.  Only these rows, one per task, reach the driver,
    and what a task's first key carries in goes back to the rows by broadcast.
    The result is a stored table.
    """
    spark = df.sparkSession
    columns, summed = df.columns, [*sums, *xors]
    is_xor = [False] * len(sums) + [True] * len(xors)
    extra = [f"{c}_before" for c in summed]

    def run(batches):
        part = TaskContext.get().partitionId()
        last, first, head_ended, carried, schema = None, None, False, [np.int64(0)] * len(summed), None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            starts = _segments(keys)
            lengths = np.diff(np.append(starts, len(keys)))
            if last is None:
                first = keys[0]
            elif keys[0] != last:
                carried, head_ended = [np.int64(0)] * len(summed), True
            head = np.zeros(len(keys), bool)
            if not head_ended:
                head[: lengths[0]] = True
                head_ended = len(starts) > 1
            ahead = []
            for i, c in enumerate(summed):
                values = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
                found, whole = _before(values, starts, lengths, carried[i], is_xor[i])
                ahead.append(pa.array(found))
                carried[i] = whole
            last = keys[-1]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *ahead, pa.array(np.full(n, part, np.int32)), pa.array(head),
                 pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool))],
                names=[*columns, *extra, "_part", "_head", "_first", "_tail"])
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([last]) if c == key else pa.nulls(1, schema.field(c).type) for c in columns),
                 *(pa.array([v], pa.int64()) for v in carried), pa.array([part], pa.int32()), pa.array([not head_ended]),
                 pa.array([first], pa.int64()), pa.array([True])],
                names=[*columns, *extra, "_part", "_head", "_first", "_tail"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    schema = ", ".join([*kinds, *(f"`{c}` long" for c in extra), "_part int, _head boolean, _first long, _tail boolean"])
    ranges = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    held = store(ranges.mapInArrow(run, schema), name)
    rows, ends = held.where("not _tail"), held.where("_tail").select("_part", "_first", "_head", key, *extra).collect()
    carry, at, whole = [], None, [0] * len(summed)
    for end in sorted(ends, key=lambda r: r["_part"]):
        inside = whole if end["_first"] == at else [0] * len(summed)
        carry.append((end["_part"], *inside))
        mine = [end[c] for c in extra]
        alone = end["_head"]  # the task has rows of one key only
        whole = [_join(a, b, x) for a, b, x in zip(inside, mine, is_xor)] if alone else mine
        at = end[key]
    if not any(any(c[1:]) for c in carry):
        return rows.select(*columns, *extra)
    carried = spark.createDataFrame(carry, ", ".join(["_part int", *(f"_{c} long" for c in extra)]))
    joined = rows.join(F.broadcast(carried), "_part")  # one row per task
    return joined.select(*columns, *[
        F.when(F.col("_head"), F.col(c).bitwiseXOR(F.col(f"_{c}")) if x else F.col(c) + F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        for c, x in zip(extra, is_xor)])


def _join(a: int, b: int, xor: bool) -> int:
    return a ^ b if xor else a + b
