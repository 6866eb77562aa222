"""Documents without a schema: one JSON text a row, filtered as VARIANT values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with the text of ``column`` as a VARIANT ``doc``; null where it is no JSON object."""
    doc = F.try_parse_json(F.col(column))
    return lines.withColumn("doc", F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc))


def documents(lines: DataFrame, column: str = "value") -> DataFrame:
    return parsed(lines, column).where("doc is not null").drop(column)


def corrupt(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that are no document, kept as they are."""
    return parsed(lines, column).where("doc is null").drop("doc")


def _path(name: str) -> str:
    quote = "'" if "'" not in name else '"'
    if quote in name:
        raise ValueError(f"no path to a field with both kinds of quotes: {name}")
    return f"$[{quote}{name}{quote}]"


def _kind(name: str) -> Column:
    """Type of a field in a row's document; null if it is missing or null."""
    kind = F.schema_of_variant(F.try_variant_get("doc", _path(name), "variant"))
    return F.when(kind != "VOID", kind)


def field(name: str, kind: str) -> Column:
    """A field as ``kind``, null where it is missing or of another type."""
    wanted = {"string": _kind(name) == "STRING", "boolean": _kind(name) == "BOOLEAN"}.get(kind, _kind(name).rlike(NUMBERS))
    return F.when(wanted, F.try_variant_get("doc", _path(name), kind))


def shown(name: str) -> Column:
    """A field of any type as text."""
    return F.try_variant_get("doc", _path(name), "string")


def _typed(name: str, operand) -> Column:
    if isinstance(operand, bool):
        return field(name, "boolean")
    if isinstance(operand, int):
        return field(name, "decimal(38,9)")
    if isinstance(operand, float):
        return field(name, "double")
    if isinstance(operand, str):
        return field(name, "string")
    raise TypeError(f"no filter by {type(operand).__name__}")


def _equal(name: str, operand) -> Column:
    if operand is None:
        return _kind(name).isNull()
    return F.coalesce(_typed(name, operand) == F.lit(operand), F.lit(False))


def _member(name: str, operands) -> Column:
    return reduce(Column.__or__, [_equal(name, o) for o in operands], F.lit(False))


def _test(name: str, op: str, operand) -> Column:
    if op == "$in":
        return _member(name, operand)
    if op == "$ne":
        return ~_equal(name, operand)
    compare = {"$gte": Column.__ge__, "$lte": Column.__le__, "$gt": Column.__gt__}.get(op)
    return F.coalesce(compare(_typed(name, operand), F.lit(operand)), F.lit(False)) if compare else F.lit(True)


def matches(condition: dict) -> Column:
    """The document filter over ``doc``: as ``filters.matches``, but a field's type may differ from row to row.

    Values of different types are neither equal nor ordered; a missing field
    reads as null; ``$ne`` keeps whatever is not equal.
    """
    tests = []
    for name, wanted in condition.items():
        if isinstance(wanted, dict):
            tests += [_test(name, op, operand) for op, operand in wanted.items()]
        else:
            tests.append(_member(name, wanted) if isinstance(wanted, (list, tuple)) else _equal(name, wanted))
    return reduce(Column.__and__, tests, F.lit(True))


def find(docs: DataFrame, condition: dict) -> DataFrame:
    return docs.where(matches(condition))
