import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from watchkeep import constants as C
from watchkeep.operators import cases

COMMANDS = "cmd_id long, ts timestamp, incident_id long, actor string, cmd string, new_status string, new_severity string, new_assignee string, content string"


def commands(spark, rows):
    df = spark.createDataFrame(rows, COMMANDS.replace("ts timestamp", "us long"))
    from pyspark.sql import functions as F

    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def incidents(spark, rows):
    return spark.createDataFrame(rows, "incident_id long, title string, status string, severity string, assigned_to string")


def test_all_pairs_of_statuses(spark):
    pairs = [(a, b) for a in C.INCIDENT_STATUSES for b in C.INCIDENT_STATUSES]
    cases_ = incidents(spark, [(i, "t", a, "low", "x") for i, (a, _) in enumerate(pairs)])
    cmds = commands(spark, [(i, i, i, "a", "transition", b, None, None, None) for i, (_, b) in enumerate(pairs)])
    got = {r.incident_id: r.accepted for r in cases.decide(cases_, cmds).collect()}
    assert got == {i: b in C.LEGAL_STEPS[a] for i, (a, b) in enumerate(pairs)}


def loop(start, rows):
    state, out = dict(start), {}
    for cmd_id, us, incident, _, cmd, status, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        if incident not in state:
            out[cmd_id] = False
        elif cmd == "transition" or (cmd == "update" and status is not None):
            out[cmd_id] = status in C.LEGAL_STEPS.get(state[incident], [])
            if out[cmd_id]:
                state[incident] = status
        else:
            out[cmd_id] = True
    return out, state


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_busy_case_spreads_over_chunks(spark, partitions):
    rng = random.Random(partitions)
    start = {i: rng.choice([*C.INCIDENT_STATUSES[:4], "odd"]) for i in range(12)}
    rows = []
    for i in range(900):
        incident = 3 if rng.random() < 0.5 else rng.randint(0, 15)
        cmd = rng.choice(["transition", "transition", "update", "note"])
        status = None if cmd == "note" or rng.random() < 0.1 else rng.choice(C.INCIDENT_STATUSES[:4] + ["nonsense"])
        rows.append((i, rng.randint(0, 300), incident, "a", cmd, status, None, None, None))
    df = incidents(spark, [(i, "t", s, "low", "x") for i, s in start.items()])
    decided = cases.decide(df, commands(spark, rows), partitions)
    want, state = loop(start, rows)
    assert {r.cmd_id: r.accepted for r in decided.collect()} == want
    assert {r.incident_id: r.status for r in cases.snapshot(df, decided).collect()} == state


def test_update_sets_fields_and_an_illegal_status_rejects_all_of_it(spark):
    df = incidents(spark, [(1, "t", "open", "low", "x"), (2, "t", "open", "low", "x")])
    cmds = commands(spark, [
        (1, 10, 1, "ann", "update", None, "high", "bo", None),
        (2, 20, 1, "cy", "update", "resolved", "critical", "di", None),
        (3, 30, 1, "ed", "update", "open", "critical", None, None),
        (4, 40, 1, "flo", "transition", "investigating", None, None, None),
        (5, 50, 2, "gus", "note", None, None, None, "seen"),
    ])
    decided = cases.decide(df, cmds)
    by_id = {r.incident_id: r for r in cases.snapshot(df, decided).collect()}
    first, second = by_id[1], by_id[2]
    assert (first.status, first.severity, first.assigned_to, first.updated_by) == ("investigating", "high", "bo", "ann")
    assert second.updated_at is None and second.status == "open"
    assert [(r.note, r.actor) for r in cases.status_changes(decided).collect()] == [("Status changed: open → investigating", "flo")]
    assert [(r.content, r.author) for r in cases.notes(decided).collect()] == [("seen", "gus")]
    assert sorted(r.cmd_id for r in cases.rejected(decided).collect()) == [2, 3]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([cases.BAD, *range(5), *range(cases.OPENS, cases.OPENS + 7)]), max_size=70))
def test_scan_equals_one_step_at_a_time(targets):
    targets = np.array(targets, dtype=np.int64)
    scanned = cases.prefixes(cases.maps_of(targets))
    run = cases.CaseRun()
    run.advance(targets)
    for start in cases.PLACES:
        state = start
        for target, mapped in zip(targets.tolist(), scanned):
            if target >= cases.OPENS:
                state = target - cases.OPENS
            elif target >= 0 and cases.LEGAL[state, target]:
                state = target
            assert cases.met(mapped, start) == state
        assert run.moves()[start] == state


def test_composing_maps_is_associative():
    maps = np.array([cases.packed(np.random.default_rng(i).integers(0, 7, 7)) for i in range(30)])
    a, b, c = maps, np.roll(maps, 1), np.roll(maps, 2)
    assert (cases.then(cases.then(a, b), c) == cases.then(a, cases.then(b, c))).all()


def test_commands_that_move_nothing_are_not_sorted(spark):
    df = incidents(spark, [(1, "t", "open", "low", "x"), (1, "t", "open", "low", "x")])
    cmds = commands(spark, [
        (1, -5, 1, "a", "note", None, None, None, "early"), (2, 1, 9, "a", "note", None, None, None, "nobody"),
        (3, 2, 1, "a", "update", None, "high", None, None), (4, 3, None, "a", "note", None, None, None, "null")])
    decided = cases.decide(df, cmds)
    assert sorted((r.cmd_id, r.found, r.accepted) for r in decided.collect()) == [
        (1, True, True), (2, False, False), (3, True, True), (4, False, False)]
    assert sorted(r.reason for r in cases.rejected(decided).collect()) == ["Incident not found"] * 2
