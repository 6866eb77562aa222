"""Searches: document filters, keyword search, paging, newest rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from watchkeep.functions.text import text
from watchkeep.operators.pages import FEW, deep_page

KEYWORD_FIELDS = ["message", "raw_log", "hostname", "source_ip"]
SEARCH_FIELDS = ["severity", "hostname", "source_ip", "event_type", "log_source"]


def _all(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests, F.lit(True))


def equals_given(**fields) -> Column:
    """Conjunction of equalities; an empty value means no condition."""
    return _all([F.col(name) == value for name, value in fields.items() if value not in (None, "")])


def matches(condition: dict, columns: list[str]) -> Column:
    """Column for a document filter, meant for ``where``: null counts as false.
    Elsewhere wrap it in ``holds``.

    A plain value means equality, a list membership, a dict one or more of
    ``$gte $lte $gt $in $ne``; other operators are ignored.  A missing column
    reads as null.  Comparisons drop nulls, ``$ne`` keeps them.
    """
    tests = []
    for name, wanted in condition.items():
        value = F.col(name) if name in columns else F.lit(None)
        if isinstance(wanted, dict):
            tests += [_operator(value, op, operand) for op, operand in wanted.items()]
        elif isinstance(wanted, (list, tuple)):
            tests.append(_member(value, wanted))
        else:
            tests.append(value.isNull() if wanted is None else value == wanted)
    return _all(tests)


def holds(condition: dict, columns: list[str]) -> Column:
    """``matches`` with null made false.  Filters go without it: a plain
    comparison reaches the parquet reader, a wrapped one does not."""
    return F.coalesce(matches(condition, columns), F.lit(False))


def _member(value: Column, wanted) -> Column:
    known = [w for w in wanted if w is not None]
    test = value.isin(known) if known else F.lit(False)
    return (test | value.isNull()) if len(known) < len(list(wanted)) else test


def _operator(value: Column, op: str, operand) -> Column:
    if op == "$in":
        return _member(value, operand)
    if op == "$ne":
        return ~value.eqNullSafe(operand)
    compare = {"$gte": Column.__ge__, "$lte": Column.__le__, "$gt": Column.__gt__}.get(op)
    return compare(value, operand) if compare else F.lit(True)


def find(df: DataFrame, condition: dict) -> DataFrame:
    return df.where(matches(condition, df.columns))


def keyword(word: str, fields: list[str] | None = None) -> Column:
    """Case-insensitive substring in any of the fields."""
    low = word.lower()
    return reduce(Column.__or__, [F.lower(text(f)).contains(low) for f in fields or KEYWORD_FIELDS])


def newest_first(df: DataFrame, time: str = "created_at", tiebreak: str = "log_id") -> list[Column]:
    return [F.col(time).desc_nulls_last(), F.col(tiebreak).desc()]


def sorted_page(
    df: DataFrame, field: str = "created_at", tiebreak: str = "log_id",
    descending: bool = True, skip: int = 0, limit: int = 100,
) -> DataFrame:
    """One page in order; ties go by ``tiebreak`` in the same direction.

    A page beyond the first rows is found by order statistics.
    """
    if skip > FEW:
        return deep_page(df, [field, tiebreak], descending, skip, limit)
    direction = F.desc if descending else F.asc
    ordered = df.orderBy(direction(field), direction(tiebreak))
    return (ordered.offset(skip) if skip else ordered).limit(limit)


def newest(df: DataFrame, limit: int, tiebreak: str = "log_id", skip: int = 0) -> DataFrame:
    return sorted_page(df, "created_at", tiebreak, True, skip, limit)


def counted_page(df: DataFrame, tiebreak: str, skip: int, limit: int, word: str | None = None, scope: str = "page") -> DataFrame:
    """A page plus the total of matching rows in column ``total``.

    An empty page is one row of nulls with the total.

    With ``scope='page'`` the keyword narrows the page after paging and the
    total ignores it; with ``scope='all'`` it narrows the search itself.
    """
    if word and scope == "all":
        df, word = df.where(keyword(word)), None
    if skip > FEW:
        rows = df.count()
        total = df.sparkSession.range(1).select(F.lit(rows).alias("total"))
        page = deep_page(df, ["created_at", tiebreak], True, skip, limit, rows)
    else:
        total = df.agg(F.count("*").alias("total"))
        page = newest(df, limit, tiebreak, skip)
    if word:
        page = page.where(keyword(word))
    # One row on the left; at most ``limit`` rows on the right.
    return total.join(page, F.lit(True), "left").select(*df.columns, "total")


def search_logs(
    logs: DataFrame, word: str | None = None, skip: int = 0, limit: int = 100, scope: str = "page", **fields,
) -> DataFrame:
    return counted_page(logs.where(equals_given(**fields)), "log_id", skip, limit, word, scope)


def live_feed(logs: DataFrame, severity: str | None = None, word: str | None = None) -> DataFrame:
    """Feed filter: message and host in any case, address in the exact case."""
    test = F.lit(True) if not severity else F.col("severity") == severity
    if word:
        low = word.lower()
        test = test & (
            F.lower(text("message")).contains(low) | text("source_ip").contains(word) | F.lower(text("hostname")).contains(low)
        )
    return logs.where(test)


def newest_match(df: DataFrame, condition: dict, tiebreak: str = "log_id") -> DataFrame:
    """The newest row that matches."""
    return newest(find(df, condition), 1, tiebreak)


def newest_per_key(df: DataFrame, key: str, tiebreak: str = "log_id") -> DataFrame:
    """The newest row of every key at once, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*rest), F.struct("created_at", tiebreak)).alias("row")
    return df.groupBy(key).agg(row).select(key, "row.*")


def geo_events(logs: DataFrame, limit: int | None = 200) -> DataFrame:
    """Newest events that carry a position."""
    located = logs.where(F.col("geo_lat").isNotNull())
    chosen = located if limit is None else newest(located, limit)
    return chosen.select(
        "log_id", "source_ip", F.coalesce("country", F.lit("Unknown")).alias("country"),
        F.col("geo_lat").alias("lat"), F.col("geo_lon").alias("lon"), "severity", "event_type",
    )


def detail_rows(df: DataFrame, key: str) -> DataFrame:
    """Each row as (key, field, value) text rows; lists joined, null as a dash."""
    shown = []
    for field in df.schema.fields:
        if field.name == key:
            continue
        is_list = field.dataType.typeName() == "array"
        value = F.when(F.col(field.name).isNotNull(), F.concat_ws(", ", field.name)) if is_list else F.col(field.name).cast("string")
        shown.append(F.coalesce(value, F.lit("—")).alias(field.name))
    names = [f.name for f in df.schema.fields if f.name != key]
    return df.select(key, *shown).unpivot([key], names, "field", "value")
