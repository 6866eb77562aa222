"""Threshold rules over a stream, batch by batch.

Rows arrive out of order, and a rule that resets must see them in order.  Each
micro-batch therefore settles the rows up to the watermark (newest time seen
minus the allowed delay) with the same ordered fold as a batch job, and keeps

* ``pending``: rows younger than the watermark, and
* ``carry``: per key the settled rows that still count, at most one less than
  the threshold.  Folding starts from them, so no other state is needed.

Both are small tables in a shared folder.  A key in keyed operator state would
be handled by one task however hot it is; here the fold spreads it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from watchkeep.operators.thresholds import threshold_firings
from watchkeep.plans.detection import qualifying, with_matches
from watchkeep.plans.rules import Rule
from watchkeep.session import materialise

END = 2**62  # a watermark after every time


@dataclass
class ThresholdState:
    """Where the state of a stream lives.

    Versions alternate between two slots: a batch reads its predecessor's slot
    and overwrites the one before that, so a repeated batch finds what it found
    the first time.
    """

    spark: SparkSession
    folder: str

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}-{batch % 2}"

    def read(self, table: str, batch: int, schema) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table, batch))

    def write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(table, batch))

    def clock(self, batch: int) -> int:
        if batch < 0:
            return -END
        row = self.spark.read.parquet(self._path("clock", batch)).first()
        if row.batch != batch:
            raise RuntimeError(f"state of batch {batch} is missing from {self.folder}")
        return row.watermark

    def set_clock(self, batch: int, watermark: int) -> None:
        self.write(self.spark.createDataFrame([(batch, watermark)], "batch long, watermark long"), "clock", batch)


def settle(
    logs: DataFrame, batch: int, rules: list[Rule], state: ThresholdState, delay_seconds: int, final: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Alerts that this micro-batch settles, and the logs that came too late, whole.

    A log without a time has no place in a window and counts as late.

    ``final`` settles everything pending, at the end of a stream.
    """
    active = [r for r in rules if r.threshold is not None]
    limits = {r.name: r.threshold for r in active}
    fresh = materialise(qualifying(logs, active).withColumn("us", F.unix_micros("created_at")))
    before = state.clock(batch - 1)
    newest = logs.agg(F.max(F.unix_micros("created_at")).alias("us")).first().us
    reached = before if newest is None else max(before, newest - delay_seconds * 1_000_000)
    watermark = END if final else reached

    missed = fresh.where(F.col("us").isNull() | (F.col("us") <= before)).select("log_id").distinct()
    late = logs.join(missed, "log_id", "left_semi")
    waiting = fresh.where(F.col("us") > before).unionByName(state.read("pending", batch - 1, fresh.schema))
    carried = state.read("carry", batch - 1, fresh.schema)
    settled = materialise(waiting.where(F.col("us") <= watermark).unionByName(carried))
    fired = materialise(threshold_firings(settled, limits, "rule", "key", "created_at", "log_id", "value"))

    state.write(waiting.where(F.col("us") > watermark), "pending", batch)
    state.write(_still_counting(settled, fired, active, watermark), "carry", batch)
    state.set_clock(batch, watermark)
    return with_matches(fired.drop("us"), active), late


def _still_counting(settled: DataFrame, fired: DataFrame, rules: list[Rule], watermark: int) -> DataFrame:
    """Settled rows inside a later row's window and after their key's last
    firing; of each value the newest, and no more values than can matter."""
    age = reduce(
        lambda test, r: test.when(F.col("rule") == r.name, F.lit(r.threshold.micros)), rules[1:],
        F.when(F.col("rule") == rules[0].name, F.lit(rules[0].threshold.micros)),
    )
    room = reduce(
        lambda test, r: test.when(F.col("rule") == r.name, F.lit(r.threshold.count - 1)), rules[1:],
        F.when(F.col("rule") == rules[0].name, F.lit(rules[0].threshold.count - 1)),
    )
    most = max(r.threshold.count for r in rules) - 1
    last = fired.groupBy("rule", "key").agg(F.max(F.struct("us", "log_id")).alias("last"))
    young = settled.where(F.lit(watermark) - F.col("us") < age).join(last, ["rule", "key"], "left")
    after = young.where(F.col("last").isNull() | (F.struct("us", "log_id") > F.col("last"))).drop("last")
    # Rows of count rules have no value: each is its own.
    own = F.coalesce("value", F.concat(F.lit("row:"), F.col("log_id").cast("string")))
    newest = [F.desc("us"), F.desc("log_id")]
    per_value = Window.partitionBy("rule", "key", own).orderBy(*newest)
    per_key = Window.partitionBy("rule", "key").orderBy(*newest)
    return (
        after.withColumn("place", F.row_number().over(per_value)).where("place = 1").drop("place")
        .withColumn("place", F.row_number().over(per_key)).where(F.col("place") <= most)
        .where(F.col("place") <= room).drop("place").select(settled.columns)
    )
