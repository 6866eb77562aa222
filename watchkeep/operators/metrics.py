"""Counts, rankings, shares and timelines.

``cap`` arguments restrict a figure to the newest rows, as a live dashboard
does; without one the whole table counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchkeep import constants as C
from watchkeep.operators.filters import matches, newest
from watchkeep.sources.tables import fixed_table


def _capped(df: DataFrame, cap: int | None, tiebreak: str) -> DataFrame:
    return df if cap is None else newest(df, cap, tiebreak)


def count_matching(df: DataFrame, condition: dict | None = None) -> DataFrame:
    return df.where(matches(condition or {}, df.columns)).agg(F.count("*").alias("n"))


def severity_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("severity", F.lit("info")).alias("severity")).agg(F.count("*").alias("n"))


def log_stats(logs: DataFrame, cap: int | None = None) -> DataFrame:
    """Total and counts by severity, source and event type as (dimension, value, n).

    Without a cap one scan counts all dimensions; with one, the total and the
    severities still cover the whole table.
    """
    unknown = F.lit("unknown")
    shaped = lambda df: df.select(
        F.coalesce("severity", F.lit("info")).alias("severity"),
        F.coalesce("log_source", unknown).alias("log_source"),
        F.coalesce("event_type", unknown).alias("event_type"),
    )
    if cap is None:
        return _dimension_counts(shaped(logs), ["severity", "log_source", "event_type"], total=True)
    whole = _dimension_counts(shaped(logs), ["severity"], total=True)
    recent = _dimension_counts(shaped(newest(logs, cap)), ["log_source", "event_type"], total=False)
    return whole.unionByName(recent)


def _dimension_counts(df: DataFrame, names: list[str], total: bool) -> DataFrame:
    # The combinations are few: count them first, then add up per dimension.
    grouped = df.groupBy(*names).agg(F.count("*").alias("n"))
    entries = [F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in names]
    if total:
        entries.append(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")))
    return (
        grouped.select("n", F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.dimension", "e.value").agg(F.sum("n").alias("n"))
    )


def top_values(logs: DataFrame, field: str, limit: int = 10, cap: int | None = None) -> DataFrame:
    """Most frequent non-empty values; ties go to the one seen latest.

    Only plain numbers and times are aggregated, so this stays a hash aggregate.
    """
    return (
        _capped(logs, cap, "log_id")
        .where(F.col(field) != "")
        .groupBy(field)
        .agg(F.count("*").alias("n"), F.max("created_at").alias("latest"))
        .orderBy(F.desc("n"), F.desc("latest"), F.asc(field))
        .limit(limit)
        .select(field, "n")
    )


def technique_coverage(alerts: DataFrame, cap: int | None = None) -> DataFrame:
    """Alerts per technique, most frequent first; ties go by the newest alert, then by the place in its list."""
    return (
        _capped(alerts, cap, "alert_id")
        .select("created_at", F.posexplode("mitre_techniques").alias("place", "technique"))
        .groupBy("technique")
        .agg(F.count("*").alias("n"), F.max("created_at").alias("latest"), F.max_by("place", "created_at").alias("place"))
        .orderBy(F.desc("n"), F.desc("latest"), F.asc("place"), F.asc("technique"))
        .select("technique", "n")
    )


def _tally(df: DataFrame, keys: list[str], figures: dict[str, Column], breakdown: str | None = None) -> DataFrame:
    """Figures of one table as (metric, value, n), in one scan.

    Rows are counted per combination of ``keys``, of which there are few; each
    figure adds up the combinations that meet its condition, zero if none does.
    ``breakdown`` names a further figure with one value per severity.
    """
    spark = df.sparkSession
    counted = df.groupBy(*[F.coalesce(k, F.lit("info")).alias(k) if k == "severity" else F.col(k) for k in keys]).agg(
        F.count("*").alias("n"))
    entries = [F.when(test, F.struct(F.lit(name).alias("metric"), F.lit("all").alias("value"))) for name, test in figures.items()]
    if breakdown:
        entries.append(F.struct(F.lit(breakdown).alias("metric"), F.col("severity").alias("value")))
    met = counted.select("n", F.explode(F.array(*entries)).alias("entry")).where("entry is not null").select("entry.*", "n")
    zero = fixed_table(spark, [(name, "all", 0) for name in figures], "metric string, value string, n bigint")
    return met.unionByName(zero).groupBy("metric", "value").agg(F.sum("n").alias("n"))


def dashboard_stats(logs: DataFrame, alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Headline figures as (metric, value, n); critical alerts are the open ones."""
    every, status = F.lit(True), F.col("status")
    critical = (F.col("severity") == "critical") & ~F.col("acknowledged")
    open_ones = {"open_incidents": status == "open", "investigating": status == "investigating", "contained": status == "contained"}
    return (
        _tally(logs, ["severity"], {"total_logs": every}, "severity_breakdown")
        .unionByName(_tally(alerts, ["severity", "acknowledged"], {"total_alerts": every, "critical_alerts": critical}, "alert_severity"))
        .unionByName(_tally(incidents, ["status"], open_ones))
    )


def alert_summary(alerts: DataFrame) -> DataFrame:
    figures = {"unacknowledged": ~F.col("acknowledged"), "critical": F.col("severity") == "critical"}
    return _tally(alerts, ["severity", "acknowledged"], figures, "by_severity")


def report_summary(logs: DataFrame, alerts: DataFrame, incidents: DataFrame, since: Column | None = None) -> DataFrame:
    """Report figures; critical alerts count acknowledged ones too.

    ``since`` restricts every table to a real reporting period.
    """
    if since is not None:
        logs, alerts, incidents = [df.where(F.col("created_at") >= since) for df in (logs, alerts, incidents)]
    every = F.lit(True)
    return (
        _tally(logs.withColumn("one", F.lit(1)), ["one"], {"total_logs": every})
        .unionByName(_tally(
            alerts, ["severity"], {"total_alerts": every, "critical_alerts": F.col("severity") == "critical"}, "severity_breakdown"))
        .unionByName(_tally(incidents, ["status"], {"open_incidents": F.col("status") == "open"}))
    )


def incident_stats(incidents: DataFrame) -> DataFrame:
    """Every known status, zero-filled, and the total over all incidents."""
    named = {s: F.col("status") == s for s in C.INCIDENT_STATUSES}
    return _tally(incidents, ["status"], {**named, "total": F.lit(True)}).select(F.col("metric").alias("status"), "n")


def whole_percent(part: Column, total: Column) -> Column:
    """Share in whole percent, half up, in integer arithmetic."""
    return F.when(total > 0, F.floor((200 * part + total) / (2 * total))).otherwise(0).cast("bigint")


def severity_share(df: DataFrame) -> DataFrame:
    counts = severity_counts(df)
    total = F.sum("n").over(_one_frame())
    return counts.select("severity", "n", whole_percent(F.col("n"), total).alias("percent"))


def _one_frame():
    """A window over a handful of already grouped rows, never over raw rows."""
    return Window.partitionBy(F.lit(1))


def geo_summary(points: DataFrame) -> DataFrame:
    country = F.coalesce("country", F.lit("Unknown"))
    by_country = points.groupBy(country.alias("country")).agg(F.count("*").alias("n"))
    return by_country.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("countries"))


def country_counts(points: DataFrame) -> DataFrame:
    """Events per country and the size of the country's marker."""
    grouped = points.groupBy(F.coalesce("country", F.lit("Unknown")).alias("country")).agg(F.count("*").alias("n"))
    return grouped.withColumn("marker", F.least(F.col("n") * 2 + 4, F.lit(16).cast("bigint")))


def relative_bars(ranked: DataFrame) -> DataFrame:
    """Bar width in percent of the top item, at most 100."""
    top = F.max("n").over(_one_frame())
    return ranked.withColumn("width", F.least(F.lit(100.0), F.col("n") * 100.0 / F.greatest(top, F.lit(1))))


def per_second(logs: DataFrame, as_of: Column, seconds: int = 60) -> DataFrame:
    """Events of the last ``seconds`` seconds, one row a second, zero-filled."""
    end = F.unix_seconds(as_of)
    second = F.unix_seconds("created_at")
    # Comparing the time itself lets the reader skip row groups.
    recent = logs.where(
        (F.col("created_at") >= F.timestamp_seconds(end - seconds)) & (F.col("created_at") < F.timestamp_seconds(end)))
    return _on_spine(recent, second, _spine(logs, F.sequence(end - seconds, end - 1)), {"eps": F.count("*")}).select(
        F.timestamp_seconds("slot").alias("second"), F.date_format(F.timestamp_seconds("slot"), "HH:mm:ss").alias("time"), "eps"
    )


def severity_timeline(logs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Hourly counts of four severities over the last hours, zero-filled."""
    end = F.floor(F.unix_seconds(as_of) / 3600)
    hour = F.floor(F.unix_seconds("created_at") / 3600)
    recent = logs.where(F.col("created_at") >= F.timestamp_seconds((end - hours + 1) * 3600)).where(hour <= end)
    counts = {s: F.count_if(F.col("severity") == s) for s in C.SEVERITIES[:4]}
    return _on_spine(recent, hour, _spine(logs, F.sequence(end - hours + 1, end)), counts).select(
        F.timestamp_seconds(F.col("slot") * 3600).alias("hour"),
        F.date_format(F.timestamp_seconds(F.col("slot") * 3600), "HH:00").alias("label"),
        *counts,
    )


def _spine(df: DataFrame, slots: Column) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(slots).alias("slot"))


def _on_spine(df: DataFrame, slot: Column, spine: DataFrame, counts: dict[str, Column]) -> DataFrame:
    grouped = df.groupBy(slot.alias("slot")).agg(*[c.alias(n) for n, c in counts.items()])
    return spine.join(grouped, "slot", "left").na.fill(0, list(counts))


def latest_time(df: DataFrame) -> Column:
    """``as_of`` default: the time of the newest row, as a scalar subquery."""
    return df.agg(F.max("created_at").alias("t")).scalar()


def known_sources(logs: DataFrame) -> DataFrame:
    """All known log sources with the number of logs seen, unused ones too."""
    seen = logs.groupBy("log_source").agg(F.count("*").alias("n"))
    known = fixed_table(logs.sparkSession, [(s,) for s in C.LOG_SOURCES], "log_source string")
    return known.join(seen, "log_source", "left").na.fill(0, ["n"])
