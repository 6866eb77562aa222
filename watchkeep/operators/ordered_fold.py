"""Exact sequential folds over keys of any size.

Some results depend on the order of a key's rows: a threshold that resets when
it fires, a case that only moves along legal steps.  A window or a collected
list per key would put one hot key on one task.  Here the rows are sorted once
by (key, time, id) into range partitions, so a hot key spreads over many
*chunks*, and the fold is stitched across chunk borders:

1. every chunk reports what its last key leaves behind (``edges``);
2. a chunk that lies wholly inside one key reports, for every state it might
   start in, the state it ends in (``moves``);
3. composing those small tables gives each chunk its true starting state, and
   one more narrow pass over the chunks produces the rows.

This works because the fold's state has few possible values, named *phases*
(0, 1, ...), once a short *context* of preceding rows is known.  The small
tables hold one row per chunk, so their size follows the number of partitions
and never the data; it is checked before they are broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from watchkeep.session import materialise

KEY, CHUNK, HEAD, CONTEXT, PHASE = "fold_key", "fold_chunk", "fold_head", "fold_context", "fold_phase"
MOST_CONTEXT = 16_000_000  # entries over all chunks that may be broadcast
ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


class Fold:
    """What a fold must provide.  A *run* is its position within one key."""

    def fresh(self, batch: pa.RecordBatch, row: int):
        """A run at the key's first row."""
        raise NotImplementedError

    def resume(self, key: str, context, phase: int):
        """A run that continues from the given context and phase."""
        raise NotImplementedError

    def explore(self, key: str, context):
        """A run that tracks every possible phase at once."""
        raise NotImplementedError

    def advance(self, run, batch: pa.RecordBatch, start: int, stop: int):
        """Consume rows [start, stop); return the output for ``emit``, or None."""
        raise NotImplementedError

    def emit(self, batch: pa.RecordBatch, outputs: list) -> pa.RecordBatch | None:
        """Output rows for one batch from [(start, stop, output)]."""
        raise NotImplementedError

    def context(self, run):
        return None

    def merge(self, key: str, context, before):
        """Context after a chunk, given the chunk's own and the one before it."""
        return context

    def context_size(self) -> int:
        """Most entries a context can have."""
        return 1

    def idle(self, key: str, rows: int) -> bool:
        """True if a key of so few rows, seen whole, has no output."""
        return False

    def sweep(self, batch: pa.RecordBatch, segments: list[tuple[str, int, int]], last: str | None, run):
        """Consume a batch of several keys: (last key, its run, outputs for ``emit``).

        ``run`` is the position within key ``last``, which may go on here.
        """
        outputs = []
        for position, (key, start, stop) in enumerate(segments):
            if key != last:
                # A key that begins here and ends before the batch does is seen whole.
                if position < len(segments) - 1 and self.idle(key, stop - start):
                    continue
                last, run = key, self.fresh(batch, start)
            output = self.advance(run, batch, start, stop)
            if output is not None:
                outputs.append((start, stop, output))
        return last, run, outputs


def sorted_chunks(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Sort by key and order into range partitions and store the result."""
    by = [F.col(KEY), *[F.col(c) for c in order]]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return materialise(
        ranged.sortWithinPartitions(*by)
        .withColumn(CHUNK, F.spark_partition_id())
        .withColumn(HEAD, F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)) == 0)
    )


def ordered_fold(
    df: DataFrame,
    fold: Fold,
    order: list[str],
    schema: StructType,
    partitions: int | None = None,
) -> DataFrame:
    """Run ``fold`` over each ``fold_key`` of ``df`` in ``order``."""
    # The result does not depend on the number of chunks; their contexts are broadcast.
    most = max(1, MOST_CONTEXT // max(1, fold.context_size()))
    wanted = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = sorted_chunks(df, order, most if wanted > most else partitions)
    count = chunks.rdd.getNumPartitions()
    if count <= 1:  # nothing to stitch
        ready = chunks.withColumn(CONTEXT, F.lit(None).cast("string")).withColumn(PHASE, F.lit(None).cast("int"))
    else:
        ready = _with_head(chunks, _starts(chunks, fold))
    return ready.mapInArrow(lambda batches: _produce(batches, fold), schema)


def _with_head(chunks: DataFrame, small: DataFrame) -> DataFrame:
    """Attach a chunk's entry of ``small`` to the chunk's first row only.

    ``small`` has at most one row per partition of ``chunks``; a broadcast join
    keeps the order of the rows.
    """
    slot = small.withColumnRenamed(CHUNK, "fold_slot")
    at_head = F.when(F.col(HEAD), F.col(CHUNK)) == F.col("fold_slot")
    return chunks.join(F.broadcast(slot), at_head, "left").drop("fold_slot")


def _starts(chunks: DataFrame, fold: Fold) -> DataFrame:
    edges = chunks.mapInArrow(
        lambda batches: _edges(batches, fold),
        f"{CHUNK} int, first_key string, last_key string, {CONTEXT} string, {PHASE} int",
    )
    parts = edges.select(
        F.col("first_key").alias(KEY), CHUNK, F.lit(True).alias("enters"),
        (F.col("first_key") == F.col("last_key")).alias("leaves"), CONTEXT, PHASE,
    ).unionByName(
        edges.where("first_key <> last_key").select(
            F.col("last_key").alias(KEY), CHUNK, F.lit(False).alias("enters"), F.lit(True).alias("leaves"), CONTEXT, PHASE,
        )
    )
    # Read twice below, and each reading would run the pass over all chunks again.
    linked = materialise(
        parts.groupBy(KEY).applyInPandas(
            lambda pdf: _link(pdf, fold),
            f"{KEY} string, {CHUNK} int, enters boolean, leaves boolean, {CONTEXT} string, {PHASE} int",
        )
    )
    inside = linked.where(f"enters and leaves and {CONTEXT} is not null").select(CHUNK, CONTEXT)
    moves = _with_head(chunks.join(F.broadcast(inside.select(CHUNK)), CHUNK, "left_semi"), inside).mapInArrow(
        lambda batches: _moves(batches, fold), f"{CHUNK} int, moves array<int>"
    )
    return (
        linked.join(moves, CHUNK, "left")
        .groupBy(KEY)
        .applyInPandas(_compose, f"{CHUNK} int, {CONTEXT} string, {PHASE} int")
    )


def _segments(batch: pa.RecordBatch) -> list[tuple[str, int, int]]:
    """Stretches of equal key: (key, start, stop)."""
    encoded = pc.run_end_encode(batch.column(batch.schema.get_field_index(KEY)))
    start, found = 0, []
    for key, stop in zip(encoded.values.to_pylist(), encoded.run_ends.to_pylist()):
        found.append((key, start, stop))
        start = stop
    return found


def _cell(batch: pa.RecordBatch, name: str, row: int = 0):
    return batch.column(batch.schema.get_field_index(name))[row].as_py()


def _edges(batches: Iterator[pa.RecordBatch], fold: Fold) -> Iterator[pa.RecordBatch]:
    chunk = first = last = run = None
    for batch in batches:
        if not batch.num_rows:
            continue
        segments = _segments(batch)
        if first is None:
            chunk, first = _cell(batch, CHUNK), segments[0][0]
        # Only the key open at the end of the batch can be the chunk's last one.
        key, start, stop = segments[-1]
        if key != last:
            last, run = key, fold.fresh(batch, start)
        fold.advance(run, batch, start, stop)
    if first is not None:
        yield pa.RecordBatch.from_pydict(
            {
                CHUNK: pa.array([chunk], pa.int32()),
                "first_key": pa.array([first], pa.string()),
                "last_key": pa.array([last], pa.string()),
                CONTEXT: pa.array([json.dumps(fold.context(run))], pa.string()),
                PHASE: pa.array([run.phase()], pa.int32()),
            }
        )


def _link(parts: pd.DataFrame, fold: Fold) -> pd.DataFrame:
    """Give each chunk that continues a key the context left by earlier chunks.

    Rows are the chunks of one key.  Afterwards the context column holds what a
    chunk receives (null where the key begins) and the phase column what the
    key's first chunk hands on.
    """
    rows, before = [], None
    for part in parts.sort_values(CHUNK).itertuples(index=False):
        own = json.loads(getattr(part, CONTEXT))
        begins = not rows
        received = None if begins else json.dumps(before)
        phase = getattr(part, PHASE) if begins else None
        rows.append((getattr(part, KEY), getattr(part, CHUNK), part.enters, part.leaves, received, phase))
        before = own if begins else fold.merge(getattr(part, KEY), own, before)
    linked = pd.DataFrame(rows, columns=[KEY, CHUNK, "enters", "leaves", CONTEXT, PHASE])
    return linked.astype({PHASE: "Int32"})


def _moves(batches: Iterator[pa.RecordBatch], fold: Fold) -> Iterator[pa.RecordBatch]:
    chunk = run = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if run is None:
            chunk = _cell(batch, CHUNK)
            run = fold.explore(_cell(batch, KEY), json.loads(_cell(batch, CONTEXT)))
        fold.advance(run, batch, 0, batch.num_rows)
    if run is not None:
        yield pa.RecordBatch.from_pydict(
            {CHUNK: pa.array([chunk], pa.int32()), "moves": pa.array([run.moves()], pa.list_(pa.int32()))}
        )


def _compose(parts: pd.DataFrame) -> pd.DataFrame:
    rows, phase = [], None
    for part in parts.sort_values(CHUNK).itertuples(index=False):
        if phase is None:
            phase = int(getattr(part, PHASE))
            continue
        rows.append((getattr(part, CHUNK), getattr(part, CONTEXT), phase))
        if part.leaves:
            phase = int(part.moves[phase])
    return pd.DataFrame(rows, columns=[CHUNK, CONTEXT, PHASE])


def _produce(batches: Iterator[pa.RecordBatch], fold: Fold) -> Iterator[pa.RecordBatch]:
    last = run = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is None and _cell(batch, PHASE) is not None:
            last = _cell(batch, KEY)
            run = fold.resume(last, json.loads(_cell(batch, CONTEXT)), _cell(batch, PHASE))
        last, run, outputs = fold.sweep(batch, _segments(batch), last, run)
        rows = fold.emit(batch, outputs)
        if rows is not None and rows.num_rows:
            yield rows
