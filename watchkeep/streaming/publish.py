"""Typed messages for live readers, and what is worth a notification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchkeep import constants as C

KINDS = ["log", "alert", "incident", "stats"]


def envelope(df: DataFrame, kind: str, key: str | None = None) -> DataFrame:
    """Rows as ``{"type": kind, "data": row}`` in column ``value``, for any text
    sink; a Kafka sink takes the same columns."""
    if kind not in KINDS:
        raise ValueError(f"unknown message type {kind!r}")
    message = F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("data")))
    columns = [F.col(key).cast("string").alias("key")] if key else []
    return df.select(*columns, message.alias("value"))


def opened(messages: DataFrame, schema) -> DataFrame:
    """The rows inside the messages of ``envelope``."""
    return messages.select(F.from_json("value", schema).alias("message")).select("message.type", "message.data.*")


def to_notify(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("severity").isin(C.NOTIFY_SEVERITIES))


def unread(alerts: DataFrame, since: Column) -> DataFrame:
    """Number of alerts after the moment the list was last read."""
    return alerts.where(F.col("created_at") > since).agg(F.count("*").alias("unread"))
