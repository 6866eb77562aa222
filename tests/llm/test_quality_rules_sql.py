"""The quality rules against their SQL, on documents that lose lines."""

import random

import duckdb
import pandas as pd

from checks.compare import rows_of
from watchkeep.llm import quality_rules
from watchkeep.llm.common import prepare
from watchkeep.llm.quality_rules_sql import QUALITY_RULES

WORDS = [f"w{i}ord" for i in range(400)]


def prose(seed, n=40):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def fixture():
    line, rare = "subscribe to our letter now", "a line of five documents"
    # Host h: a line in 140 documents, and one in five, which is not over the limit.
    rows = [(i, f"{line}\n{rare}\n{prose(i)}" if i < 5 else f"  {line.upper()} \n\n{prose(i)}", "h") for i in range(140)]
    # Under 20 words left; 25 words left, which are under 30 percent.
    rows += [(200, f"{line}\n{prose(200, 18)}", "h"), (201, f"{line}\n" * 30 + prose(201, 25), "h")]
    # Copies are one document: 101 rows of one text on host c leave its line.
    rows += [(300 + i, f"{line}\n{prose(300)}", "c") for i in range(101)]
    # On a host of 1,200 documents one percent is the larger limit: 11 are under it, 13 are over.
    rows += [(1000 + i, "\n".join(["under one percent"] * (i < 11) + ["over one percent"] * (i < 13) + [prose(1000 + i, 21)]), "big")
             for i in range(1200)]
    # A host of six documents: the rule acts on small hosts as well.
    return rows + [(5000 + i, f"seen in all six\n{prose(5000 + i)}", "six") for i in range(6)]


def test_removed_lines_and_depleted_documents_equal_sql(spark):
    rows = fixture()
    prepare(spark)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = quality_rules.line_rules(frame).drop("host", "content")
    got = found.collect()

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    result = con.execute(QUALITY_RULES)
    columns = [d[0] for d in result.description]
    assert rows_of(found.columns, got) == rows_of(columns, result.fetchall())

    by = {r["doc_id"]: r for r in got}
    assert by[0]["removed_words"] == by[139]["removed_words"] == 5 and by[0]["kept"]
    assert by[200]["removed_words"] == 5 and not by[200]["base_failed"] and not by[200]["kept"]
    assert by[201]["removed_words"] == 150 and not by[201]["kept"]
    assert by[300]["removed_words"] == 0 and by[1000]["removed_words"] == 3 and by[5003]["removed_words"] == 4


def test_cleaned_documents_lose_lines_and_nothing_else(spark):
    prepare(spark)
    rows = [(*r, len(r[1]), "clash") for r in fixture()] + [(6000, None, "h", 0, "x"), (6001, "", None, 0, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, content int, host string")
    kept = {r["doc_id"] for r in quality_rules.line_rules(frame).where("kept").collect()}
    found = quality_rules.cleaned(frame)
    by = {r["doc_id"]: r for r in found.collect()}
    assert found.columns == frame.columns and set(by) == kept and not {200, 201, 6000, 6001} & kept
    gone = {"subscribe to our letter now": "h", "over one percent": "big", "seen in all six": "six"}
    for r in rows:
        if r[0] in kept:
            assert by[r[0]]["text"] == "\n".join(x for x in r[1].split("\n") if gone.get(" ".join(x.lower().split())) != r[2])
            assert (by[r[0]]["content"], by[r[0]]["host"]) == r[3:]
    assert {r["doc_id"] for r in quality_rules.passing(frame).collect()} == kept
    whole = {r["doc_id"]: r["text"] for r in quality_rules.without_frequent_lines(frame).collect()}
    assert len(whole) == len({r[0] for r in rows}) and whole[6000] is None and whole[200] == prose(200, 18)
    assert quality_rules.cleaned(frame.limit(0)).count() == 0
