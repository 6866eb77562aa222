"""Fill-in-middle: the skip list against plain sums, round trips, and the SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from checks.compare import rows_of
from watchkeep.llm import fill_in_middle as fim
from watchkeep.llm.common import prepare
from watchkeep.llm.fill_in_middle_sql import FILL_IN_MIDDLE
from watchkeep.llm.queries import op12_fill_in_middle

SCHEMA = "doc_id long, text string, key string, n int, form string, h1 long, output string"


@pytest.mark.parametrize("n", [1, 2, 3, 17, 400, 5000])
def test_every_rank_is_found_in_few_steps(n):
    widths = np.array(random.Random(n).choices(range(50), k=n), np.int64)
    lines, sums = fim.SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
    assert [lines.chars_before(r) for r in range(n + 1)] == sums.tolist()
    for (units, chars, _), (above_units, above_chars, down) in zip(lines.lanes, lines.lanes[1:]):
        assert sum(units) == sum(above_units) == n and sum(chars) == sum(above_chars)
        assert len(above_units) == len(down) < len(units)
    assert n < 400 or len(lines.lanes) > 3


def test_an_empty_list_has_no_units():
    assert fim.SkipList(fim.line_lengths("")).chars_before(0) == 0


def texts():
    make = random.Random(4)
    rows = ["", None, "\n", "\n\n\n", "one", "one\n", "a\nb", "é\n漢字\n😀x", "x<P>y\nz", "<S>", "a<M>", "<P\n>\n<", "a\r\nb c\x0bd\n"]
    rows += ["".join(make.choices("ab\n<P>é", k=make.randrange(60))) for _ in range(200)]
    return rows + ["line\n" * 40_000 + "end", "w" * 300_000]


def rows():
    numbered = list(enumerate(texts())) + [(5, "one\n"), (5, "two\nlines"), (None, "no id\nat all"), (-3, "minus\nthree")]
    return [(*r, "k", 1, "f", 2, "o") for r in numbered]


def brute(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return (doc_id, len(lines), "plain", None, None, sha(text), sha(text))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(lines), form, len(p), len(m), sha(out), sha(text))


def query(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return op12_fill_in_middle(spark, folder)


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    data = rows()
    found = query(prepare(spark), str(tmp_path), data)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=str) == sorted((brute(r[0], r[1]) for r in data), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in data], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = con.execute(FILL_IN_MIDDLE)
    assert rows_of(found.columns, got) == rows_of([c[0] for c in want.description], want.fetchall())


def test_share_of_cut_documents_and_empty_table(spark):
    prepare(spark)
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('a', id, '\nb\nc') as text")
    few = fim.fill_in_middle(docs, rate=30, spm=0).groupBy("form").count().collect()
    counts = {r["form"]: r["count"] for r in few}
    assert set(counts) == {"plain", "psm"} and 450 < counts["psm"] < 750
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_long_outputs_leave_in_several_batches(spark, monkeypatch):
    prepare(spark)
    docs = spark.createDataFrame([(i, "word\n" * (i % 7)) for i in range(50)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(fim, "OUTPUT_CHARS", 40)
    batch = docs.selectExpr("doc_id as key", "text", "doc_id as h1", "3L as h2", "0L as h3", "0L as h4").toArrow().to_batches()[0]
    parts = list(fim._cut(batch, 100, 50))
    assert len(parts) > 5 and [k for p in parts for k in p["key"].to_pylist()] == list(range(50))
