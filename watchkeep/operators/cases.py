"""Case workflow: fold a command log into incident state.

A command is a ``transition``, an ``update`` or a ``note``.  Status may only
move along legal steps, so whether a command is accepted depends on all earlier
ones of its case.  The fold has one phase per status; incidents enter it as the
first row of their key, which saves a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from watchkeep import constants as C
from watchkeep.operators.ordered_fold import KEY, Fold, ordered_fold

STATES = C.INCIDENT_STATUSES
UNKNOWN, MISSING = len(STATES), len(STATES) + 1  # a status outside the list; no such incident
LEGAL = np.zeros((len(STATES) + 2, len(STATES)), dtype=bool)
for _status, _steps in C.LEGAL_STEPS.items():
    for _step in _steps:
        LEGAL[STATES.index(_status), STATES.index(_step)] = True

TIME, ORDER_ID, TARGET = "fold_time", "fold_id", "fold_target"
OPENS, BAD = 100, -1  # an incident's own row; an unknown status


BITS = 3  # of a status in a packed map
PLACES = range(MISSING + 1)


def packed(states) -> int:
    """The map that takes status s to ``states[s]``."""
    return sum(int(state) << BITS * s for s, state in enumerate(states))


def constant(state: int) -> int:
    return packed([state] * len(PLACES))


def met(maps, state):
    """Where maps take a status."""
    return (maps >> BITS * state) & ((1 << BITS) - 1)


def then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The maps that do ``first`` and then ``second``."""
    out = np.zeros_like(first)
    for s in PLACES:
        out |= met(second, met(first, s)) << BITS * s
    return out


def prefixes(maps: np.ndarray) -> np.ndarray:
    """For every place the composition of all maps up to it, in log steps."""
    out, width = maps.copy(), 1
    while width < len(out):
        out[width:] = then(out[:-width], out[width:])
        width *= 2
    return out


# By target; the last entry is for commands that leave every status as it is.
STEPS = np.array(
    [packed([t if LEGAL[s, t] else s for s in PLACES]) for t in range(len(STATES))] + [packed(PLACES)], dtype=np.int64)
OPENINGS = np.array([constant(s) for s in PLACES], dtype=np.int64)


def maps_of(targets: np.ndarray) -> np.ndarray:
    opens = targets >= OPENS
    return np.where(opens, OPENINGS[np.where(opens, targets - OPENS, 0)], STEPS[np.where((targets >= 0) & ~opens, targets, len(STATES))])


class CaseRun:
    """The map from a status at the start to the status now."""

    def __init__(self, start: int | None = None):
        self.map = np.int64(packed(PLACES) if start is None else constant(start))

    def phase(self) -> int:
        return int(met(self.map, 0))

    def moves(self) -> list[int]:
        return [int(met(self.map, s)) for s in PLACES]

    def advance(self, targets: np.ndarray) -> None:
        if len(targets):
            self.map = then(np.array([self.map]), prefixes(maps_of(targets))[-1:])[0]


def _targets(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(TARGET)).to_numpy(zero_copy_only=False).astype(np.int64)


class CaseFold(Fold):
    def __init__(self, columns: list[str]):
        self.columns = columns

    def fresh(self, batch, row):
        return CaseRun(MISSING)

    def resume(self, key, context, phase):
        return CaseRun(phase)

    def explore(self, key, context):
        return CaseRun()

    def advance(self, run, batch, start, stop):
        run.advance(_targets(batch)[start:stop])

    def sweep(self, batch, segments, last, run):
        maps, heads = maps_of(_targets(batch)), np.array([start for _, start, _ in segments])
        goes_on = segments[0][0] == last
        heads = heads[1:] if goes_on else heads
        # A key begins without an incident, whatever was before.
        maps[heads] = then(OPENINGS[np.full(len(heads), MISSING)], maps[heads])
        scanned = prefixes(maps)
        entry = met(run.map, 0) if goes_on else MISSING
        before = np.append(entry, met(scanned[:-1], entry))
        before[heads] = MISSING
        return segments[-1][0], CaseRun(int(met(scanned[-1], entry))), [(0, batch.num_rows, before)]

    def emit(self, batch, outputs):
        targets = _targets(batch)
        before = np.full(len(targets), MISSING)
        for start, stop, states in outputs:
            before[start:stop] = states
        step = np.clip(targets, 0, len(STATES) - 1)
        accepted = (before != MISSING) & (targets >= 0) & LEGAL[before, step]
        names = np.array([*STATES, None, None], dtype=object)
        arrays = [batch.column(batch.schema.get_field_index(c)) for c in self.columns]
        arrays += [pa.array(names[before], pa.string()), pa.array(before != MISSING), pa.array(accepted)]
        whole = pa.RecordBatch.from_arrays(arrays, names=[*self.columns, "from_status", "found", "accepted"])
        return whole.filter(pa.array(targets < OPENS))


def decide(incidents: DataFrame, commands: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each command with whether its incident exists and whether it is accepted.

    Commands that may move a status also say which one they met; the others are
    accepted if there is an incident, at any time, and are only looked up.
    """
    index = lambda column: F.coalesce(*[F.when(column == s, F.lit(i)) for i, s in enumerate(STATES)])
    moves = F.coalesce((F.col("cmd") == "transition") | ((F.col("cmd") == "update") & F.col("new_status").isNotNull()), F.lit(False))
    opening = incidents.select(
        F.col("incident_id").cast("string").alias(KEY),
        F.lit(-(2**63)).cast("bigint").alias(TIME),
        (F.coalesce(index(F.coalesce("status", F.lit("open"))), F.lit(UNKNOWN)) + OPENS).cast("int").alias(TARGET),
    )
    steps = commands.where(moves).select(
        "*",
        F.col("incident_id").cast("string").alias(KEY),
        F.unix_micros("ts").alias(TIME),
        F.col("cmd_id").alias(ORDER_ID),
        F.coalesce(index(F.col("new_status")), F.lit(BAD)).cast("int").alias(TARGET),
    )
    schema = StructType(
        [
            *commands.schema.fields,
            StructField("from_status", StringType()),
            StructField("found", BooleanType()),
            StructField("accepted", BooleanType()),
        ]
    )
    rows = steps.unionByName(opening, allowMissingColumns=True)
    moved = ordered_fold(rows, CaseFold(commands.columns), [TIME, ORDER_ID], schema, partitions)
    known = incidents.select(F.col("incident_id").cast("string").alias(KEY))
    same = F.col("incident_id").cast("string") == known[KEY]
    rest = commands.where(~moves)
    told = lambda df, found: df.withColumns(
        {"from_status": F.lit(None).cast("string"), "found": F.lit(found), "accepted": F.lit(found)})
    return moved.unionByName(told(rest.join(known, same, "left_semi"), True)).unionByName(told(rest.join(known, same, "left_anti"), False))


def status_changes(decisions: DataFrame) -> DataFrame:
    """Timeline entries of accepted transitions; updates leave none."""
    return decisions.where("accepted and cmd = 'transition'").select(
        "incident_id", "ts", F.lit("status_change").alias("action"), "actor",
        F.concat(F.lit("Status changed: "), "from_status", F.lit(" → "), "new_status").alias("note"),
        "cmd_id",
    )


def notes(decisions: DataFrame) -> DataFrame:
    return decisions.where("accepted and cmd = 'note'").select(
        "incident_id", "ts", F.col("actor").alias("author"), "content", "cmd_id")


def rejected(decisions: DataFrame) -> DataFrame:
    """Commands without effect: unknown incidents and illegal steps."""
    reason = (
        F.when(~F.col("found"), "Incident not found")
        .otherwise(F.concat(F.lit("Cannot transition from "), F.coalesce("from_status", F.lit("unknown")), F.lit(" to "),
                            F.coalesce("new_status", F.lit("nothing"))))
    )
    return decisions.where("not accepted").select("cmd_id", "incident_id", "cmd", reason.alias("reason"))


def snapshot(incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Incidents after all accepted commands.

    The last accepted value of each field is found by partial aggregates, so a
    case with very many commands sends one row per task.
    """
    last = lambda column, when: F.expr(f"max_by({column}, struct(ts, cmd_id)) filter (where {when} and {column} is not null)")
    changed = decisions.where("accepted and cmd <> 'note'").groupBy("incident_id").agg(
        last("new_status", "true").alias("to_status"),
        last("new_severity", "cmd = 'update'").alias("to_severity"),
        last("new_assignee", "cmd = 'update'").alias("to_assignee"),
        F.max("ts").alias("updated_at"),
        last("actor", "cmd = 'update'").alias("updated_by"),
    )
    return incidents.join(changed, "incident_id", "left").withColumns(
        {
            "status": F.coalesce("to_status", "status"),
            "severity": F.coalesce("to_severity", "severity"),
            "assigned_to": F.coalesce("to_assignee", "assigned_to"),
        }
    ).drop("to_status", "to_severity", "to_assignee")
