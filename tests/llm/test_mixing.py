"""The mix: targets, words taken, evenness of the schedule, and the SQL."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.compare import rows_of
from watchkeep.llm import mixing
from watchkeep.llm.common import prepare
from watchkeep.llm.mixing_sql import MIXING
from watchkeep.llm.queries import op11_mixing

SCHEMA = "doc_id long, text string, source string, row long, size long, number long, target double"


def words(n, seed=0):
    return " ".join(random.Random(seed).choices(["a", "bé", "c,d", "\x0b", "e f"], k=n))


@pytest.fixture(scope="module")
def rows():
    make = random.Random(5)
    out = [(i, words(make.randrange(300), i), make.choice(["hot", "hot", "b", "É", "aa", None])) for i in range(400)]
    out += [(500, "few words", "tiny"), (501, "", "empty"), (502, None, "empty"), (503, words(40_000), "z"), (None, words(9), ""), (None, words(9), "")]
    out += [(7, words(50), "hot")] * 3 + [(600 + i, "x", "ones") for i in range(700)]
    return [(*r, 1, 2, 3, 4.0) for r in out]


def targets(rows, share=1.5):
    """Resharing in rounds, as the definition says it."""
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, budget, out = set(order), share * sum(sizes.values()), {}
    while left:
        total = sum(weight[s] for s in left)
        over = {s for s in left if budget * weight[s] / total > 2 * sizes[s]}
        if not over:
            return sizes, {**out, **{s: budget * weight[s] / total for s in left}}
        out |= {s: 2.0 * sizes[s] for s in over}
        budget -= sum(2 * sizes[s] for s in over)
        left -= over
    return sizes, out


def test_query_equals_definition_and_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_mixing(spark, str(tmp_path))
    got = [tuple(r) for r in found.collect()]
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(got) == len(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select doc_id, text, source from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(MIXING)
    assert rows_of(found.columns, got) == rows_of([c[0] for c in want.description], want.fetchall())
    assert rows_of(found.columns, got) == rows_of(found.columns, [tuple(r) for r in op11_mixing(spark, str(tmp_path)).collect()])


def test_sources_meet_their_targets(spark, rows):
    prepare(spark)
    mix, account = mixing.mixture(spark.createDataFrame(rows, SCHEMA).repartition(3), block=64)
    sizes, wanted = targets(rows)
    by_source = {r["source"]: r for r in account.groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()}
    assert set(by_source) == set(wanted)
    for s, r in by_source.items():
        assert r["size"] == sizes[s] and r["over"] <= 0
        assert r["target"] == pytest.approx(wanted[s]) and abs(r["taken"] - wanted[s]) <= 0.5
    pieces = mix.collect()
    assert all(0 < p["words"] <= 64 and p["epoch"] in (0, 1) for p in pieces)
    blocks = {}
    for p in pieces:
        blocks.setdefault((p["number"], p["block"]), []).append(p)
    last = {n: max(b for m, b in blocks if m == n) for n, _ in blocks}
    assert all(sum(p["words"] for p in ps) == 64 for (n, b), ps in blocks.items() if b < last[n])
    # A place holds one block, and every stretch holds a source near its share.
    place = {k: {p["position"] for p in ps} for k, ps in blocks.items()}
    assert all(len(p) == 1 for p in place.values())
    placed = sorted((p.pop(), n) for (n, b), p in place.items())
    placed = [n for at, n in placed if at != mixing.LAST]
    share = {n: placed.count(n) / len(placed) for n in last}
    for begin in range(0, len(placed) - 200, 97):
        for n, s in share.items():
            assert abs(placed[begin: begin + 200].count(n) - 200 * s) <= 6


def test_pieces_cover_documents_once_an_epoch(spark, rows):
    prepare(spark)
    mix, account = mixing.mixture(spark.createDataFrame(rows, SCHEMA), percent=200, block=100)
    sizes = {r["row"]: r["size"] for r in account.collect()}
    spans = {}
    for p in mix.collect():
        spans.setdefault((p["row"], p["epoch"]), []).append((p["first"], p["words"]))
    assert {r for r, _ in spans} == {r for r, size in sizes.items() if size}
    for (row, _), parts in spans.items():
        at = 0
        for first, n in sorted(parts):
            assert first == at
            at += n
        assert at == sizes[row]


def test_no_words_make_an_empty_mix(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    mix, account = mixing.mixture(docs.limit(0))
    assert mix.count() == account.count() == 0
    mix, account = mixing.mixture(docs.where("source = 'empty'"))
    assert mix.count() == 0 and [(r["target"], r["taken"]) for r in account.collect()] == [(0.0, 0)] * 2
