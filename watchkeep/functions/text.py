"""Text columns: null-safe reading, phrase tests, identifiers, display forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def text(name: str | Column) -> Column:
    """The value, with null read as empty text."""
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def named(name: str, default: str = "unknown") -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _quoted(phrase: str) -> str:
    return "'" + phrase.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_phrase(column: str, phrases: list[str]) -> Column:
    """True if the named column contains one of the phrases (case-sensitive)."""
    return F.expr(" or ".join(f"contains({column}, {_quoted(p)})" for p in phrases))


def phrases_found(column: str, phrases: list[str], at_most: int) -> Column:
    """The first phrases, in list order, that the named column contains."""
    tests = ", ".join(f"case when contains({column}, {_quoted(p)}) then {_quoted(p)} end" for p in phrases)
    found = F.expr(f"concat_ws('\x1f', {tests})")
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(found, "\x1f"), 1, at_most))


def stable_id(*parts: Column) -> Column:
    """Identifier that is the same on every run."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def techniques(csv: str | Column) -> Column:
    """List from comma-separated text; empty text is an empty list."""
    column = text(csv)
    return F.when(column == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))


def joined(array: str | Column, separator: str = ",") -> Column:
    return F.coalesce(F.concat_ws(separator, array), F.lit(""))


def format_bytes(size: str | Column) -> Column:
    """Size as text in steps of 1000, one decimal; nothing or zero is ``0 B``."""
    value = (F.col(size) if isinstance(size, str) else size).cast("bigint")
    out = F.when(value.isNull() | (value == 0), F.lit("0 B"))
    for step, unit in ((10**12, "TB"), (10**9, "GB"), (10**6, "MB"), (1000, "KB"), (1, "B")):
        tenths = F.floor((value * 10 + step // 2) / F.lit(float(step)))
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = out.when(value >= step, shown)
    return out


def time_ago(moment: str | Column, now: Column) -> Column:
    """Age as text in whole seconds, minutes, hours or days."""
    then = F.col(moment) if isinstance(moment, str) else moment
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(then)) / F.lit(1_000_000))
    return (
        F.when(then.isNull(), F.lit("—"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
    )


def clock(moment: str | Column, pattern: str) -> Column:
    """Time as text, e.g. ``HH:mm:ss`` or ``HH:00``."""
    return F.date_format(moment, pattern)
