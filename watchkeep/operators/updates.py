"""Table changes as new tables: set, delete, acknowledge, escalate, create.

Plain files have no in-place update, so every change returns the new table for
the caller to write to a new path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchkeep.functions.text import stable_id
from watchkeep.operators.filters import holds, matches


def _set(df: DataFrame, hit: Column, values: dict) -> DataFrame:
    changes = {}
    for name, value in values.items():
        new = value if isinstance(value, Column) else F.lit(value)
        old = F.col(name) if name in df.columns else F.lit(None)
        changes[name] = F.when(hit, new).otherwise(old)
    return df.withColumns(changes)


def update_many(df: DataFrame, condition: dict, values: dict) -> DataFrame:
    """Set values on all matching rows."""
    return _set(df, holds(condition, df.columns), values)


def update_one(df: DataFrame, condition: dict, values: dict, key: str, time: str = "created_at") -> DataFrame:
    """Set values on the matching row inserted first: the earliest time, then the lowest key."""
    first = df.where(matches(condition, df.columns)).agg(F.min(F.struct(time, key))[key].alias("first")).scalar()
    return _set(df, F.coalesce(F.col(key) == first, F.lit(False)), values)


def delete_matching(df: DataFrame, condition: dict) -> DataFrame:
    return df.where(~holds(condition, df.columns))


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def affected(df: DataFrame, condition: dict) -> DataFrame:
    """How many rows an update or delete concerns."""
    return df.where(matches(condition, df.columns)).agg(F.count("*").alias("n"))


def latest_per(df: DataFrame, key: str, *columns: str, order: tuple[str, ...] = ("ts", "cmd_id")) -> DataFrame:
    """The last command per key, combined before the shuffle."""
    row = F.max_by(F.struct(*columns), F.struct(*order)).alias("row")
    return df.groupBy(key).agg(row).select(key, "row.*")


def acknowledge(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """Alerts with the effect of the last acknowledgement of each."""
    last = latest_per(commands, "alert_id", "actor", "notes").select("alert_id", F.col("actor").alias("by"), "notes")
    hit = F.col("by").isNotNull()
    return alerts.drop("ack_notes").join(last, "alert_id", "left").withColumns(
        {
            "acknowledged": F.col("acknowledged") | hit,
            "acknowledged_by": F.when(hit, F.col("by")).otherwise(F.col("acknowledged_by")),
            "ack_notes": F.col("notes"),
        }
    ).drop("by", "notes")


def escalation_id() -> Column:
    return stable_id(F.lit("escalation"), F.col("cmd_id").cast("string"))


def escalate(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """One new incident per escalation of an existing alert."""
    # Only the columns that travel: commands may name one alert very often, and
    # a skewed join repeats the alert's row next to each split of the commands.
    source = alerts.select(
        "alert_id", "title", "description", "severity", "source_ip", "hostname", "mitre_techniques", "tags")
    return commands.select("alert_id", "cmd_id", "ts", "actor").join(source, "alert_id").select(
        escalation_id().alias("incident_id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("[Escalated] "), F.coalesce("title", F.lit("Security Alert"))).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("severity", F.lit("high")).alias("severity"),
        F.lit("open").alias("status"),
        F.array("alert_id").alias("alert_ids"),
        F.col("actor").alias("assigned_to"),
        F.col("actor").alias("created_by"),
        "mitre_techniques",
        F.coalesce("source_ip", F.lit("")).alias("source_ip"),
        F.coalesce("hostname", F.lit("")).alias("hostname"),
        "tags",
    )


def escalation_timeline(incidents: DataFrame) -> DataFrame:
    """First timeline entry of escalated incidents."""
    return incidents.select(
        "incident_id", F.col("created_at").alias("ts"), F.lit("incident_created").alias("action"),
        F.col("created_by").alias("actor"), F.concat(F.lit("Escalated from alert "), F.col("alert_ids")[0]).alias("note"),
    )


def link_alerts(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """Alerts with the incident of their last escalation."""
    last = latest_per(commands, "alert_id", "cmd_id").select("alert_id", escalation_id().alias("new_link"))
    return alerts.join(last, "alert_id", "left").withColumn(
        "incident_id", F.coalesce("new_link", "incident_id")).drop("new_link")


def alert_incidents(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """(alert, incident) pairs over the alert lists of incidents."""
    named = incidents.select("incident_id", F.col("title").alias("incident_title"), "status", F.explode("alert_ids").alias("alert_id"))
    return named.join(alerts.select("alert_id", "rule_name", "created_at"), "alert_id")


def create_incidents(requests: DataFrame) -> DataFrame:
    """Incidents from requests; the assignee defaults to the requester."""
    none = F.array().cast("array<string>")
    empty = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    return requests.select(
        stable_id(F.lit("incident"), F.col("request_id").cast("string")).alias("incident_id"),
        F.col("ts").alias("created_at"), "title", "description",
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.lit("open").alias("status"),
        F.when(F.col("assigned_to") != "", F.col("assigned_to")).otherwise(F.col("actor")).alias("assigned_to"),
        F.col("actor").alias("created_by"),
        F.coalesce("tags", none).alias("tags"),
        empty("source_ip"), empty("hostname"),
        F.coalesce("mitre_techniques", none).alias("mitre_techniques"),
        none.alias("alert_ids"),
    )


def creation_timeline(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        "incident_id", F.col("created_at").alias("ts"), F.lit("incident_created").alias("action"),
        F.col("created_by").alias("actor"), F.lit("Incident created manually").alias("note"),
    )


def create_indicators(requests: DataFrame) -> DataFrame:
    return requests.select(
        stable_id(F.lit("indicator"), F.col("request_id").cast("string")).alias("ioc_id"),
        F.col("ts").alias("created_at"), "ioc_type", "value",
        F.coalesce("threat_type", F.lit("unknown")).alias("threat_type"),
        F.coalesce("confidence", F.lit(50)).alias("confidence"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("source", F.lit("manual")).alias("source"),
        F.lit(True).alias("active"),
        F.col("actor").alias("created_by"),
        F.lit(0).alias("hit_count"),
    )
