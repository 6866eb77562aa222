"""Pages of a sorted table at any depth, by order statistics.

``orderBy.offset.limit`` keeps the whole prefix up to the page in every task and
brings it to one.  Here a small sample gives splitters, one pass counts the rows
between them, and only the range that holds the page is looked at again, until
it is small enough to be sorted.  Each round divides the rows by about the number
of splitters, and its bounds reach the reader as filters on the sort columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPLITTERS = 48
PER_SPLITTER = 20  # sampled rows for each
FEW = 10_000  # rows that one task may sort


@dataclass(frozen=True)
class SortKey:
    """A sort column as an expression; null is the smallest value."""

    column: Column
    kind: str

    def shown(self) -> Column:
        return F.unix_micros(self.column) if self.kind == "timestamp" else self.column

    def literal(self, value) -> Column:
        return F.timestamp_micros(F.lit(value)) if self.kind == "timestamp" else F.lit(value).cast(self.kind)


def _key(keys: list[SortKey]) -> Column:
    """Structs compare field by field, nulls first."""
    return F.struct(*[k.column.alias(f"k{i}") for i, k in enumerate(keys)])


def _at(keys: list[SortKey], values: tuple) -> Column:
    return F.struct(*[k.literal(v).alias(f"k{i}") for i, (k, v) in enumerate(zip(keys, values))])


def _class(keys: list[SortKey], splitters: list[tuple], low: int, high: int) -> Column:
    """2i for rows between splitters i - 1 and i, 2i + 1 for rows equal to splitter i; by halving."""
    if low == high:
        return F.lit(2 * low)
    middle = (low + high) // 2
    return (
        F.when(_key(keys) < _at(keys, splitters[middle]), _class(keys, splitters, low, middle))
        .when(_key(keys) == _at(keys, splitters[middle]), F.lit(2 * middle + 1))
        .otherwise(_class(keys, splitters, middle + 1, high))
    )


def _bounds(keys: list[SortKey], splitters: list[tuple], which: int) -> list[Column]:
    """Conditions of one class; those on the first sort column alone can reach the reader."""
    at, key, first = which // 2, _key(keys), keys[0]
    if which % 2:
        low = high = splitters[at]
        found = [key == _at(keys, low)]
    else:
        low = splitters[at - 1] if at else None
        high = splitters[at] if at < len(splitters) else None
        found = [key > _at(keys, low)] if low else []
        found += [key < _at(keys, high)] if high else []
    if low and low[0] is not None:
        found.append(first.column >= first.literal(low[0]))
        if high:
            found.append(first.column <= first.literal(high[0]))
    return found


def _order(keys: list[SortKey], rest: Column | None, descending: bool) -> list[Column]:
    columns = [k.column for k in keys] + ([] if rest is None else [rest])
    return [c.desc() if descending else c.asc() for c in columns]


def _sampled(df: DataFrame, keys: list[SortKey], rows: int, seed: int) -> list[tuple]:
    """About SPLITTERS different keys that part the rows evenly."""
    share = min(1.0, SPLITTERS * PER_SPLITTER / rows)
    shown = df.sample(share, seed).select(*[k.shown().alias(f"k{i}") for i, k in enumerate(keys)])
    found = [tuple(r) for r in shown.orderBy(*shown.columns).collect()]
    step = max(1, len(found) // SPLITTERS)
    return list(dict.fromkeys(found[step // 2::step]))


def _parts(
    df: DataFrame, keys: list[SortKey], descending: bool, rows: int, skip: int, limit: int, few: int, rest: Column | None, depth: int = 0,
) -> list[DataFrame]:
    """Frames that together hold rows ``skip`` to ``skip + limit`` of ``df``, which has ``rows`` rows."""
    order = _order(keys, rest, descending)
    if skip == 0 and rows <= limit:
        return [df]
    if skip + limit <= few or rows <= few:
        return [df.orderBy(*order).offset(skip).limit(limit) if skip else df.orderBy(*order).limit(limit)]
    splitters = _sampled(df, keys, rows, depth)
    if not splitters:
        return _parts(df, keys, descending, rows, skip, limit, few, rest, depth + 1)
    counted = df.groupBy(_class(keys, splitters, 0, len(splitters)).alias("class")).agg(F.count("*").alias("n"))
    found, before = [], 0
    for row in sorted(counted.collect(), reverse=descending):
        at, n = row["class"], row["n"]
        begin, end = max(0, skip - before), min(n, skip + limit - before)
        before += n
        if begin >= end:
            continue
        inside = df
        for bound in _bounds(keys, splitters, at):
            inside = inside.where(bound)
        if at % 2 == 0:
            found += _parts(inside, keys, descending, n, begin, end - begin, few, rest, depth + 1)
        elif rest is not None:  # equal in all sort columns
            found += _parts(inside, [SortKey(rest, "bigint")], descending, n, begin, end - begin, few, None, depth + 1)
        else:  # equal in all columns
            found.append(inside.limit(end - begin))
    return found


def deep_page(
    df: DataFrame, by: list[str], descending: bool = True, skip: int = 0, limit: int = 100, total: int | None = None, few: int = FEW,
) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of ``df`` sorted by the columns ``by``, nulls smallest.

    Rows equal in ``by`` are ordered by a hash of all columns, so that pages do
    not overlap.  Counts and splitters are found when the page is asked for, and
    ``total`` saves the first count.
    """
    kinds = dict(df.dtypes)
    keys = [SortKey(F.col(name), kinds[name]) for name in by]
    rows = df.count() if total is None else total
    limit = max(0, min(limit, rows - skip))
    if not limit:
        return df.limit(0)
    rest = F.xxhash64(*df.columns)
    parts = _parts(df, keys, descending, rows, skip, limit, max(few, 2 * limit), rest)
    page = parts[0]
    for part in parts[1:]:
        page = page.unionByName(part)
    return page.orderBy(*_order(keys, rest, descending))
