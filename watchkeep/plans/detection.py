"""Run detection rules over logs and build alerts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchkeep.functions.text import stable_id, text
from watchkeep.operators.thresholds import threshold_firings
from watchkeep.plans.rules import CARRIED, Rule, default_rules, readable

SNIPPET = 200  # characters of the raw log kept in an alert
NAMES = ["log_id", "created_at", "source_ip", "hostname", "username"]


def checked(rules: list[Rule] | None) -> list[Rule]:
    """The given rules, or the default ones for None; names must be unique."""
    chosen = default_rules() if rules is None else list(rules)
    names = [r.name for r in chosen]
    if len(set(names)) < len(names):
        raise ValueError(f"rule names must differ: {sorted({n for n in names if names.count(n) > 1})}")
    return chosen


@contextmanager
def error_free(spark: SparkSession) -> Iterator[None]:
    """Expressions put into a plan in here give null where they would raise an error.

    Casts, divisions and look-ups take the session's ANSI setting when they
    are resolved, which is when a DataFrame is made.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _match(place: int, rule: Rule, texts: bool = True) -> Column:
    """What a matching rule adds to a log; its constants are looked up later."""
    shown = lambda c: c if texts else F.lit(None).cast("string")
    return F.struct(F.lit(place).alias("place"), shown(rule.title).alias("title"), shown(rule.description).alias("description"))


def _constant(rules: list[Rule], value) -> Column:
    """A constant of the rule at the hit's place."""
    return F.get(F.array(*[value(r) for r in rules]), F.col("hit.place")) if rules else F.lit(None)


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _alerts(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """Alerts of log rows that carry a match in column ``hit``."""
    named = hits.withColumn("rule_name", _constant(rules, lambda r: F.lit(r.name)).cast("string"))
    return named.select(
        stable_id(F.col("log_id").cast("string"), F.col("rule_name")).alias("alert_id"),
        F.col("created_at"),
        F.col("hit.title").alias("title"),
        F.col("hit.description").alias("description"),
        _constant(rules, lambda r: F.lit(r.severity)).cast("string").alias("severity"),
        F.col("rule_name"),
        text("source_ip").alias("source_ip"),
        text("hostname").alias("hostname"),
        text("username").alias("username"),
        F.col("log_id"),
        _constant(rules, lambda r: _words(r.techniques)).cast("array<string>").alias("mitre_techniques"),
        _constant(rules, lambda r: _words(r.tags)).cast("array<string>").alias("tags"),
        F.lit(False).alias("acknowledged"),
        F.lit(None).cast("string").alias("acknowledged_by"),
        F.lit(None).cast("string").alias("incident_id"),
        (F.substring(text("raw_log"), 1, SNIPPET) if "raw_log" in hits.columns else F.lit(None).cast("string")).alias("raw_log_snippet"),
    )


def stateless_alerts(logs: DataFrame, rules: list[Rule] | None = None, texts: bool = True) -> DataFrame:
    """Alerts of the rules that look at one log at a time: one pass, no shuffle."""
    active = [r for r in checked(rules) if r.threshold is None]
    hits = _matched(logs, active, {r.name: _match(i, r, texts) for i, r in enumerate(active)}, "hit")
    return _alerts(hits if texts else hits.drop("raw_log"), active)


def _matched(logs: DataFrame, rules: list[Rule], entries: dict[str, Column], name: str) -> DataFrame:
    """One row per (log, matching rule) with the rule's entry as a struct.

    Each entry is a column of its own, so all predicates stay in generated
    code; the explode only lines up those that are set.  Filtering by the
    predicates first, or exploding a ready-made array column, makes the
    optimizer push copies of them below ``readable`` and repeat its texts in
    every test.

    A rule that meets an error in a log, say a text that is no number, is
    skipped for that log.
    """
    if not rules:
        nothing = F.lit(None).cast("struct<place: int, title: string, description: string>")
        return readable(logs).where("false").withColumn(name, nothing)
    columns = {f"{name}_{i}": F.when(r.when, entries[r.name]) for i, r in enumerate(rules)}
    with error_free(logs.sparkSession):
        tested = readable(logs).withColumns(columns)
    return (
        tested
        .withColumn(name, F.explode(F.filter(F.array(*columns), lambda entry: entry.isNotNull())))
        .drop(*columns)
    )


def qualifying(logs: DataFrame, rules: list[Rule], texts: bool = True) -> DataFrame:
    """Narrow rows for the threshold rules: one per (log, rule)."""
    extra = [c for r in rules for c in r.carry if c not in CARRIED]
    entry = lambda r: F.struct(
        F.lit(r.name).alias("rule"),
        r.key.alias("key"),
        (r.distinct_value if r.distinct_value is not None else F.lit(None)).cast("string").alias("value"),
    )
    # Texts stay whole: a rule's title and description may read any of them.
    kept = [F.col(c) for c in ([*CARRIED, *extra] if texts else NAMES)]
    return _matched(logs, rules, {r.name: entry(r) for r in rules}, "q").select(*kept, "q.*")


def threshold_alerts(
    logs: DataFrame, rules: list[Rule] | None = None, partitions: int | None = None, texts: bool = True,
) -> DataFrame:
    """Alerts of the rules that count over time; all of them share one shuffle.

    The logs are read once: the qualifying rows are stored.
    """
    active = [r for r in checked(rules) if r.threshold is not None]
    if not active:
        return stateless_alerts(logs.limit(0), [], texts)
    fired = threshold_firings(
        qualifying(logs, active, texts), {r.name: r.threshold for r in active},
        "rule", "key", "created_at", "log_id", "value", partitions,
    )
    return with_matches(fired, active, texts)


def with_matches(fired: DataFrame, rules: list[Rule], texts: bool = True) -> DataFrame:
    """Alerts from rows that fired, by the name in their ``rule`` column."""
    hit = F.coalesce(*[F.when(F.col("rule") == r.name, _match(i, r, texts)) for i, r in enumerate(rules)])
    with error_free(fired.sparkSession):
        fired = fired.withColumn("hit", hit)
    return _alerts(fired, rules)


def undecided(logs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(log_id, rule_name) where a rule came to no verdict: an input is missing, or its test met an error."""
    chosen = checked(rules)
    with error_free(logs.sparkSession):
        tested = readable(logs).select("log_id", *[r.when.alias(f"t{i}") for i, r in enumerate(chosen)])
    names = [F.when(F.col(f"t{i}").isNull(), F.lit(r.name)) for i, r in enumerate(chosen)]
    listed = F.array(*names) if names else F.array().cast("array<string>")
    return tested.select("log_id", F.explode(F.array_compact(listed)).alias("rule_name"))


def all_alerts(
    logs: DataFrame, rules: list[Rule] | None = None, partitions: int | None = None, texts: bool = True,
) -> DataFrame:
    """Every alert of every rule; one log may cause several.

    Without ``texts``, for counts and links, title, description and snippet
    stay null and the logs' texts are not carried along.
    """
    chosen = checked(rules)
    parts = []
    if not chosen or any(r.threshold is None for r in chosen):
        parts.append(stateless_alerts(logs, chosen, texts))
    if any(r.threshold is not None for r in chosen):
        parts.append(threshold_alerts(logs, chosen, partitions, texts))
    return reduce(DataFrame.unionByName, parts)


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Alerts with lists as comma-separated text, for flat sinks."""
    return (
        alerts.withColumn("mitre_csv", F.concat_ws(",", "mitre_techniques"))
        .withColumn("tags_csv", F.concat_ws(",", "tags"))
        .drop("mitre_techniques", "tags")
    )
