"""Risk profiles kept by a stream: the newest scores of every user, by hour.

State is a map from hour to that hour's newest scores and a list of the hours
held, newest first.  A batch touches only the hours it brings scores for, drops
hours that newer ones have pushed out of the newest ``keep``, and gives out just
these: a table of changes, of which the last row per user, share and hour counts.
A timer lets go of users that have been silent for long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from watchkeep import constants as C
from watchkeep.operators.behaviour import active

SHARES = 16  # parts a user's scores are dealt over, so that a busy user has many tasks
HOUR = 3_600_000_000
SCORES = "us array<long>, ids array<string>, risks array<int>"
CHANGES = f"username string, share int, hour long, {SCORES}"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = ["us", "ids", "risks"]


class RiskProfile(StatefulProcessor):
    """One share of one user."""

    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scores = handle.getMapState("scores", "hour long", SCORES)
        self.hours = handle.getListState("hours", "hour long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {int(hour): int(n) for hour, n in self.hours.get()} if self.hours.exists() else {}
        fresh: dict[int, pd.DataFrame] = {}
        for chunk in rows:
            for hour, part in chunk.groupby(chunk["us"] // HOUR):
                fresh[int(hour)] = self._newest([fresh.get(int(hour)), part[NAMES]])
        changed = []
        for hour, part in fresh.items():
            if hour in held:
                part = self._newest([pd.DataFrame(dict(zip(NAMES, self.scores.getValue((hour,))))), part])
            held[hour] = len(part)
            changed.append(self._row(key, hour, part))
            self.scores.updateValue((hour,), tuple(part[n].tolist() for n in NAMES))
        newer, kept = 0, []
        for hour in sorted(held, reverse=True):
            if newer < self.keep:
                kept.append((hour, held[hour]))
            else:  # newer hours have enough
                self.scores.removeKey((hour,))
                changed = [c for c in changed if c["hour"] != hour] + ([] if hour in fresh else [self._row(key, hour, None)])
            newer += held[hour]
        self.hours.put(kept)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            newest = (kept[0][0] + 1) * HOUR // 1000
            self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        if changed:
            yield pd.DataFrame(changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = [self._row(key, int(hour), None) for hour, _ in self.hours.get()] if self.hours.exists() else []
        self.hours.clear()
        self.scores.clear()
        if gone:
            yield pd.DataFrame(gone)

    def close(self) -> None:
        pass

    def _newest(self, parts: list) -> pd.DataFrame:
        whole = pd.concat([p for p in parts if p is not None])
        return whole.sort_values(["us", "ids"]).tail(self.keep)

    def _row(self, key, hour: int, part: pd.DataFrame | None) -> dict:
        return {"username": key[0], "share": key[1], "hour": hour, **{n: [] if part is None else part[n].tolist() for n in NAMES}}


def risk_changes(stream: DataFrame, keep: int = C.RISK_HISTORY, idle: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """Hours of users' newest ``keep`` risk scores, whenever they change; an empty hour is gone.

    With ``idle``, users without a score for that many seconds of event time are
    forgotten; rows later than the watermark are then dropped.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # A log without a time is the oldest of its user.
    us = F.coalesce(F.unix_micros("created_at"), F.lit(0))
    source = active(stream)
    if idle is not None:
        source = source.withWatermark("created_at", delay)
    rows = source.select(
        "username", F.pmod(F.xxhash64("log_id"), F.lit(SHARES)).cast("int").alias("share"), us.alias("us"),
        F.col("log_id").cast("string").alias("ids"), F.coalesce("risk_score", F.lit(C.DEFAULT_RISK)).cast("int").alias("risks"),
        *([F.col("created_at")] if idle is not None else []))
    return rows.groupBy("username", "share").transformWithStateInPandas(
        RiskProfile(keep, None if idle is None else idle * 1000), CHANGES, "Update", "None" if idle is None else "EventTime")


def risk_profiles(changes: DataFrame, keep: int = C.RISK_HISTORY) -> DataFrame:
    """Sum, number and peak of each user's newest scores, from a table of changes with their ``batch``.

    Hours are added up from the newest on, and scores are only listed where
    they are held: at most ``SHARES`` x ``keep`` per user, so one list is bounded.
    """
    number = F.col("batch").cast("long")
    last = changes.groupBy("username", "share", "hour").agg(F.max(number).alias("batch"))
    current = changes.withColumn("batch", number).join(last, ["username", "share", "hour", "batch"])
    scores = F.flatten(F.collect_list(F.arrays_zip("us", "ids", "risks")))
    newest = F.slice(F.sort_array(scores, asc=False), 1, keep)
    return current.groupBy("username").agg(newest.alias("kept")).where(F.size("kept") > 0).select(
        "username",
        F.aggregate("kept", F.lit(0).cast("bigint"), lambda total, x: total + x["risks"]).alias("risk_sum"),
        F.size("kept").cast("bigint").alias("risk_n"),
        F.array_max(F.transform("kept", lambda x: x["risks"])).alias("peak_risk"),
    )
