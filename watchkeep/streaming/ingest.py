"""Continuous ingest: store, profile, detect and publish every log event."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from watchkeep.operators.behaviour import hourly_counts
from watchkeep.plans.detection import stateless_alerts
from watchkeep.plans.rules import Rule, default_rules
from watchkeep.streaming.profiles import risk_changes, risk_profiles
from watchkeep.streaming.publish import envelope, to_notify
from watchkeep.streaming.thresholds import ThresholdState, settle


def read_stream(spark: SparkSession, folder: str, schema, files: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


@dataclass
class Ingest:
    """The pipeline and the folder its tables live in.

    Every table is written one folder per batch, so a repeated batch replaces
    its own output and alert ids make results idempotent for other sinks.
    """

    spark: SparkSession
    folder: str
    rules: list[Rule] = field(default_factory=default_rules)
    delay_seconds: int = 60

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def process(self, logs: DataFrame, batch: int, final: bool = False) -> None:
        """One micro-batch; also usable directly for a bulk load."""
        # Disk only: a batch may be larger than memory, and it is read several times.
        logs = logs.persist(StorageLevel.DISK_ONLY)
        try:
            self._write(logs, "logs", batch)
            self._write(hourly_counts(logs).drop("first_seen"), "user_hours", batch)
            state = ThresholdState(self.spark, f"{self.folder}/threshold_state")
            alerts = stateless_alerts(logs, self.rules)
            if any(r.threshold is not None for r in self.rules):
                counted, late = settle(logs, batch, self.rules, state, self.delay_seconds, final)
                alerts = alerts.unionByName(counted)
                self._write(late, "late", batch)
            self._write(alerts, "alerts", batch)
            stored = self.spark.read.parquet(f"{self.folder}/alerts/batch={batch}")
            messages = envelope(logs, "log", "log_id").unionByName(envelope(stored, "alert", "alert_id"))
            self._write(messages, "messages", batch)
            self._write(to_notify(stored).select("alert_id", "severity", "title"), "notifications", batch)
        finally:
            logs.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(lambda df, batch: self.process(df, batch))
        writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def start_profiles(self, stream: DataFrame, checkpoint: str, available_now: bool = False, **settings) -> StreamingQuery:
        """Keep the table ``risk_changes`` next to the others, by a query of its own; see ``risk_changes``."""
        writer = risk_changes(stream, **settings).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        writer = writer.foreachBatch(lambda df, batch: self._write(df, "risk_changes", batch))
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def risk_profiles(self) -> DataFrame:
        """Every user's newest risk scores so far, as sum, number and peak."""
        return risk_profiles(self.table("risk_changes"))

    def finish(self, schema) -> None:
        """Settle what is still pending, once the stream has ended for good."""
        last = self.table("logs").agg(F.max(F.col("batch").cast("long"))).first()[0]
        self.process(self.spark.createDataFrame([], schema), int(last) + 1, final=True)


def user_hours(table: DataFrame) -> DataFrame:
    """Hourly counts per user, summed over the batches."""
    return table.groupBy("username", "hour").agg(F.sum("events").alias("events"))
