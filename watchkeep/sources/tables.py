"""Read, append and export tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from watchkeep.functions.text import text
from watchkeep.operators.filters import newest

# Columns of the exports, in order.
LOG_EXPORT = ["created_at", "severity", "event_type", "hostname", "source_ip", "log_source", "message", "raw_log"]
ALERT_EXPORT = ["created_at", "severity", "title", "rule_name", "source_ip", "hostname", "acknowledged", "mitre_techniques"]
INCIDENT_EXPORT = ["created_at", "title", "severity", "status", "assigned_to", "source_ip", "hostname", "mitre_techniques"]
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, format: str = "parquet") -> DataFrame:
    """A stored table; with a schema, missing fields read as null."""
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(path)


def fixed_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table of fixed values, held in the plan itself."""
    names = [c.split()[0] for c in columns.split(", ")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), columns)


def with_identity(df: DataFrame, key: str, time: str = "created_at") -> DataFrame:
    """Fill a missing key (a random UUID) and a missing time.

    Equal rows get different keys.  The keys are made once, when the rows are
    stored: use the stored table afterwards, as ``append`` does.
    """
    for name, kind in ((key, "string"), (time, "timestamp")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.withColumns(
        {key: F.coalesce(F.col(key).cast("string"), F.uuid()), time: F.coalesce(F.col(time), F.current_timestamp())}
    )


def append(df: DataFrame, path: str, key: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a parquet table, completing key and time."""
    writer = with_identity(df, key).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _shown(df: DataFrame, names: list[str]) -> list:
    shown = []
    kinds = dict(df.dtypes)
    for name in names:
        kind = kinds[name]
        if kind.startswith("array"):
            column = F.concat_ws(",", name)
        elif kind == "timestamp":
            column = F.date_format(name, TIME_FORMAT)
        else:
            column = F.col(name).cast("string")
        shown.append(text(column).alias(name))
    return shown


def _chosen(df: DataFrame, limit: int | None, key: str) -> DataFrame:
    return df if limit is None else newest(df, limit, key)


def log_export(logs: DataFrame, limit: int | None = 1000) -> DataFrame:
    """The newest logs as text columns; all of them, unordered, without a limit."""
    chosen = _chosen(logs, limit, "log_id")
    return chosen.select(*_shown(chosen, LOG_EXPORT))


def alert_export(alerts: DataFrame, limit: int | None = 500) -> DataFrame:
    chosen = _chosen(alerts, limit, "alert_id")
    return chosen.select(*_shown(chosen, ALERT_EXPORT))


def incident_export(incidents: DataFrame, limit: int | None = 500) -> DataFrame:
    chosen = _chosen(incidents, limit, "incident_id")
    return chosen.select(*_shown(chosen, INCIDENT_EXPORT))


def write_csv(export: DataFrame, path: str) -> None:
    export.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
