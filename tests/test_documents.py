"""Filters over documents of mixed types, against plain dictionaries."""

import json

import pytest
from pyspark.sql import functions as F

from watchkeep.operators import documents as D

DOCS = [
    {"id": 0, "a": 5, "b": "x"}, {"id": 1, "a": "5", "b": "y"}, {"id": 2, "a": 5.0}, {"id": 3, "a": None, "b": "x"}, {"id": 4, "b": True},
    {"id": 5, "a": [1, 2], "b": {"c": 1}}, {"id": 6, "a": 7.25, "b": "é'q\\"}, {"id": 7, "a": 10**17, "b": ""}, {"id": 8, "o'dd": 1, "a": -3},
    {"id": 9, "a": False, "b": "x"}, {},
]
BROKEN = ['{"id": 1', "", None, "[1, 2]", '"text"', "nonsense"]


def number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def same(value, wanted):
    if value is None or wanted is None:
        return value is None and wanted is None
    if number(value) and number(wanted):
        return value == wanted
    return type(value) is type(wanted) and value == wanted


def holds(doc, condition):
    def test(value, op, operand):
        if op == "$in":
            return any(same(value, o) for o in operand)
        if op == "$ne":
            return not same(value, operand)
        ordered = (number(value) and number(operand)) or (isinstance(value, str) and isinstance(operand, str))
        return {"$gte": lambda: value >= operand, "$lte": lambda: value <= operand, "$gt": lambda: value > operand}.get(op, lambda: True)() if (
            ordered or op not in ("$gte", "$lte", "$gt")) else False

    out = True
    for name, wanted in condition.items():
        value = doc.get(name)
        if isinstance(wanted, dict):
            out = out and all(test(value, op, o) for op, o in wanted.items())
        else:
            out = out and (any(same(value, o) for o in wanted) if isinstance(wanted, list) else same(value, wanted))
    return out


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(json.dumps(d),) for d in DOCS] + [(b,) for b in BROKEN], "value string")


@pytest.mark.parametrize("condition", [
    {}, {"a": 5}, {"a": "5"}, {"a": None}, {"a": 7.25}, {"a": True}, {"a": False}, {"b": ["x", True, None]}, {"a": {"$gte": 5}},
    {"a": {"$gt": 5, "$lte": 7.5}}, {"a": {"$ne": 5}}, {"b": {"$ne": "x"}, "a": {"$in": [5, "5", -3]}}, {"b": {"$gte": "x"}}, {"b": "é'q\\"},
    {"o'dd": 1}, {"zzz": {"$ne": None}}, {"a": {"$near": 3}}, {"b": {"$in": []}}])
def test_filters_equal_plain_dictionaries(lines, condition):
    found = D.find(D.documents(lines), condition).select(F.expr("cast(to_json(doc) as string)").alias("doc")).collect()
    key = lambda d: str(d.get("id"))
    assert sorted(key(json.loads(r["doc"])) for r in found) == sorted(key(d) for d in DOCS if holds(d, condition))


def test_broken_lines_are_kept_aside(lines):
    assert sorted(map(str, (r["value"] for r in D.corrupt(lines).collect()))) == sorted(map(str, BROKEN))
    assert D.documents(lines).count() == len(DOCS)
    with pytest.raises(TypeError):
        D.matches({"a": {"$gte": [1]}})
