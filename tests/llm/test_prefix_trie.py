"""The trie against a brute-force one: families, copies, long and turnless conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from watchkeep.llm import prefix_trie as trie
from watchkeep.llm.common import prepare
from watchkeep.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, c long, n long, k string, key1 long, depth int"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    figures = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [figures[k] for k in kids[node]]
        figures[node] = (sum(b[0] for b in below) if below else 1, saved + sum(b[1] for b in below))
    return sorted((
        min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), *figures[node],
        hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def built(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, 2, "k", 3, 4) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(df, **settings).collect())


def order(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def rows():
    make = random.Random(11)
    rows = []
    for c in range(120):
        if c % 10 == 5:
            continue  # families without a first member, and first members of few turns
        for turn in range(make.choice([0, 1, 2, 3, 4, 7, 9, 13])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", make.choice(["a", "b", "é漢"]) * make.randrange(1, 3)))
    rows += [(1000 + 5 * i, t, "user", f"same {t}") for i in range(60) for t in range(10)]  # many copies
    rows += [(2000, t, "user", "over and over") for t in range(700)]  # a long conversation, and one that goes on after it
    rows += [(2005, t, "user", "over and over") for t in range(703)]
    rows += [(3000, None, None, None), (3000, 2, "", ""), (3005, 1, None, ""), (3005, 5, "user", None)]
    rows += [(-3, 0, "user", "minus"), (-5, 0, "user", "five"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(4000, 1, "user", "twice"), (4000, 1, "user", "twice"), (4005, 0, "user", "long " * 50_000)]
    return rows


def test_trie_equals_brute_force(spark, rows):
    assert order(built(spark, rows)) == order(brute(rows))


@pytest.mark.parametrize("block", [1, 2, 7])
def test_block_length_does_not_matter(spark, rows, block):
    few = [r for r in rows if r[0] is not None and r[0] < 60 or r[0] == 2000]
    assert order(built(spark, few, block=block)) == order(brute(few))


def test_long_lists_of_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_TEXT_BYTES", 50)
    rows = [(5 * i, 0, "user", "hello") for i in range(-150, 150)]
    assert order(built(spark, rows)) == order(brute(rows))


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, 3, "user", f"t{i}") for i in range(12)] + [(1, 4, "user", "end")]
    assert built(spark, rows) == built(spark, rows[::-1])


def test_no_conversation_has_no_root(spark):
    prepare(spark)
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "user", "x")]) == []


def test_only_turnless_conversations_make_a_childless_root(spark):
    # Families without a first member: none of the few own turns is left after the first h.
    lonely = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)
    rows = [(lonely, 0, "user", "gone")]
    assert built(spark, rows) == brute(rows)


def test_query_reads_the_given_table(spark, tmp_path, rows):
    df = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] < 40], "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    found = op13_prefix_trie(spark, str(tmp_path))
    assert tuple(found.columns) == COLUMNS and found.count() == len(brute([r for r in rows if r[0] is not None and r[0] < 40]))
