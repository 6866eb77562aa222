"""Unread alerts as a stream: alerts count up, a read mark resets the count.

Alerts and marks are one stream of two kinds.  Alerts are dealt over shares, and
every share sees every mark, so no share has all alerts.  A share's state is the
time of the last mark and how many alerts came at each time after it; both kinds
may arrive in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from watchkeep.streaming.profiles import STORE

SHARES = 8


class Unread(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "us long")
        self.times = handle.getMapState("times", "us long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = mark = int(self.mark.get()[0]) if self.mark.exists() else None
        alerts = []
        for chunk in rows:
            marks = chunk.loc[chunk["is_mark"], "us"]
            if len(marks):
                mark = int(marks.max()) if mark is None else max(mark, int(marks.max()))
            alerts.append(chunk.loc[~chunk["is_mark"], "us"])
        if mark != before:
            self.mark.update((mark,))
            for (us,) in [tuple(k) for k in self.times.keys()] if self.times.exists() else []:
                if us <= mark:
                    self.times.removeKey((us,))
        fresh = pd.concat(alerts).value_counts()
        for us, n in fresh.items():
            if mark is None or us > mark:
                place = (int(us),)
                held = int(self.times.getValue(place)[0]) if self.times.containsKey(place) else 0
                self.times.updateValue(place, (held + int(n),))
        unread = sum(int(n) for (n,) in self.times.values()) if self.times.exists() else 0
        yield pd.DataFrame({"share": [key[0]], "unread": [unread], "read_until": pd.array([mark], dtype="Int64")})

    def close(self) -> None:
        pass


def unread_counts(alerts: DataFrame, marks: DataFrame, key: str = "alert_id") -> DataFrame:
    """(share, unread, read_until) whenever a share changes; ``marks`` have a time ``created_at``.

    Alerts and marks without a time are left out: they lie neither before nor after.
    """
    alerts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    us = F.unix_micros("created_at").alias("us")
    counted = alerts.where("created_at is not null").select(
        F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int").alias("share"), us, F.lit(False).alias("is_mark"))
    read = marks.where("created_at is not null").select(
        F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), us, F.lit(True).alias("is_mark"))
    return counted.unionByName(read).groupBy("share").transformWithStateInPandas(
        Unread(), "share int, unread long, read_until long", "Update", "None")


def unread_now(counts: DataFrame) -> DataFrame:
    """The whole count, from a table of ``unread_counts`` with their ``batch``."""
    number = F.col("batch").cast("long")
    last = counts.groupBy("share").agg(F.max_by("unread", number).alias("unread"))
    return last.agg(F.coalesce(F.sum("unread"), F.lit(0)).alias("unread"))
