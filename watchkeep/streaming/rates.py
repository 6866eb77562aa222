"""Streaming aggregates: events per second, user hours, live buffers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from watchkeep.operators.behaviour import active


def events_per_second(stream: DataFrame, delay: str = "10 seconds") -> DataFrame:
    window = F.window("created_at", "1 second")
    counted = stream.withWatermark("created_at", delay).groupBy(window).agg(F.count("*").alias("eps"))
    return counted.select(F.col("window.start").alias("second"), "eps")


def events_per_hour(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    window = F.window("created_at", "1 hour")
    counted = active(stream).withWatermark("created_at", delay).groupBy(window, "username").agg(F.count("*").alias("events"))
    return counted.select("username", F.col("window.start").alias("hour"), "events")


def to_files(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to parquet files, exactly once."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def trimmed(feed: DataFrame, batch: DataFrame, limit: int, tiebreak: str = "log_id") -> DataFrame:
    """A live buffer after one more batch: the newest ``limit`` rows of both."""
    return feed.unionByName(batch).orderBy(F.desc("created_at"), F.desc(tiebreak)).limit(limit)


@dataclass
class LiveBuffer:
    """The newest ``limit`` rows of a stream, as a table that every batch renews.

    Versions alternate between two slots, so a repeated batch finds what it
    found the first time.  A buffer has at most ``limit`` rows.
    """

    spark: SparkSession
    folder: str
    limit: int
    tiebreak: str = "log_id"

    def _path(self, batch: int) -> str:
        return f"{self.folder}/buffer-{batch % 2}"

    def process(self, rows: DataFrame, batch: int) -> None:
        held = self.spark.read.schema(rows.schema).parquet(self._path(batch - 1)) if batch else rows.limit(0)
        trimmed(held, rows, self.limit, self.tiebreak).write.mode("overwrite").parquet(self._path(batch))
        self.spark.createDataFrame([(batch,)], "batch long").write.mode("overwrite").parquet(f"{self.folder}/last")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def table(self) -> DataFrame:
        last = self.spark.read.parquet(f"{self.folder}/last").first()["batch"]
        return self.spark.read.parquet(self._path(last))
