import tempfile
import time

import pytest
from pyspark.sql import functions as F

from watchkeep.plans.detection import all_alerts
from checks.derived import derive, derived
from watchkeep.schemas import EVENTS_INPUT
from watchkeep.streaming.ingest import Ingest, read_stream, user_hours
from watchkeep.streaming.publish import envelope, opened
from watchkeep.streaming.profiles import risk_profiles
from watchkeep.streaming.rates import LiveBuffer, trimmed
from watchkeep.streaming.unread import unread_counts, unread_now
from watchkeep.operators.behaviour import hourly_counts, recent_risk


@pytest.fixture(scope="module")
def pieces(spark):
    """Events of the middle data set in six files; rows up to 60 s of squeezed
    time out of order across files."""
    folder = tempfile.mkdtemp(prefix="watchkeep-pieces-")
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(450))
    place = F.floor((F.col("event_id") + jitter) / 1800)
    for piece in range(6):
        events.where(place == piece).coalesce(1).write.parquet(f"{folder}/{piece}")
    return folder


def stream_of(spark, pieces, name):
    files = spark.readStream.schema(EVENTS_INPUT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return derive(files.parquet(pieces), name)


def test_stream_equals_batch_with_disorder_and_restart(spark, pieces):
    folder = tempfile.mkdtemp(prefix="watchkeep-stream-")
    job = Ingest(spark, f"{folder}/tables", delay_seconds=60)
    stopped = job.start(stream_of(spark, pieces, "burst"), f"{folder}/checkpoint")
    while not stopped.recentProgress:
        stopped.awaitTermination(1)
    stopped.stop()
    again = Ingest(spark, f"{folder}/tables", delay_seconds=60)
    again.start(stream_of(spark, pieces, "burst"), f"{folder}/checkpoint", available_now=True).awaitTermination()
    again.finish(stream_of(spark, pieces, "burst").schema)

    logs = derived(spark, "/root/testdata/sf0.01", "burst")
    ids = lambda df: sorted(r.alert_id for r in df.select("alert_id").collect())
    assert again.table("logs").count() == logs.count()
    assert again.table("late").count() == 0
    assert ids(again.table("alerts")) == ids(all_alerts(logs))
    hours = lambda df: sorted(map(tuple, df.select("username", "hour", "events").collect()))
    assert hours(user_hours(again.table("user_hours"))) == hours(hourly_counts(logs))
    messages = again.table("messages").count()
    assert messages == logs.count() + again.table("alerts").count()
    assert again.table("notifications").count() == again.table("alerts").where("severity in ('critical', 'high')").count()


def test_late_rows_are_kept_aside(spark, pieces):
    folder = tempfile.mkdtemp(prefix="watchkeep-late-")
    job = Ingest(spark, f"{folder}/tables", delay_seconds=0)
    job.start(stream_of(spark, pieces, "burst"), f"{folder}/checkpoint", available_now=True).awaitTermination()
    assert job.table("late").count() > 0


def test_repeated_batch_changes_nothing(spark):
    folder = tempfile.mkdtemp(prefix="watchkeep-repeat-")
    job = Ingest(spark, f"{folder}/tables", delay_seconds=5)
    logs = derived(spark, "/root/testdata/sf0.001", "burst")
    middle = logs.agg(F.percentile_approx("log_id", 0.5)).first()[0]
    first, second = logs.where(F.col("log_id") <= middle), logs.where(F.col("log_id") > middle)
    for df, batch in ((first, 0), (first, 0), (second, 1), (second, 1)):
        job.process(df, batch)
    job.finish(logs.schema)
    ids = lambda df: sorted(r.alert_id for r in df.select("alert_id").collect())
    assert ids(job.table("alerts")) == ids(all_alerts(logs))


FIGURES = ["username", "risk_sum", "risk_n", "peak_risk"]


def test_risk_profiles_keep_the_newest_in_any_order(spark, pieces):
    folder = tempfile.mkdtemp(prefix="watchkeep-risk-")
    job = Ingest(spark, f"{folder}/tables")
    job.start_profiles(stream_of(spark, pieces, "logs"), f"{folder}/checkpoint", available_now=True, keep=50).awaitTermination()
    changes = job.table("risk_changes")
    key = lambda df: sorted(map(tuple, df.select(FIGURES).collect()))
    # Ids are compared as text in a stream; times are unique, so they never decide.
    assert key(risk_profiles(changes, 50)) == key(recent_risk(derived(spark, "/root/testdata/sf0.01", "logs"), 50))
    # Every batch gives out only the hours it touched or dropped.
    held = changes.where(F.size("us") > 0).select("username", "share", "hour").distinct().count()
    assert changes.select("batch").distinct().count() == 6 and changes.count() < 2 * held


def dripping(spark, rows, schema):
    """One file per row, as a stream of one file a trigger."""
    folder = tempfile.mkdtemp(prefix="watchkeep-drip-")
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{folder}/{i}")
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_silent_users_are_forgotten(spark):
    rows = [("ann", 1, 10, 40), ("bo", 2, 20, 50), ("bo", 3, 500_000, 60), ("bo", 4, 500_001, 70)]
    stream = dripping(spark, rows, "username string, log_id long, s long, risk_score int")
    live = stream.select("username", "log_id", "risk_score", F.timestamp_seconds("s").alias("created_at"))
    folder = tempfile.mkdtemp(prefix="watchkeep-idle-")
    job = Ingest(spark, f"{folder}/tables")
    job.start_profiles(live, f"{folder}/checkpoint", available_now=True, idle=3600, delay="1 minute").awaitTermination()
    assert sorted(map(tuple, job.risk_profiles().select(FIGURES).collect()))[-1][2:] == (2, 70)
    assert {r["username"] for r in job.risk_profiles().collect()} == {"bo"}


def test_unread_counts_reset_on_marks_in_any_order(spark):
    # (time, is a mark): a late mark resets nothing newer, and an alert before the last mark does not count.
    rows = [(10, False), (20, False), (15, True), (30, False), (12, False), (30, False), (25, True), (20, True)]
    stream = dripping(spark, [(i, *r) for i, r in enumerate(rows)], "alert_id long, s long, is_mark boolean")
    live = stream.select("alert_id", "is_mark", F.timestamp_seconds("s").alias("created_at"))
    folder = tempfile.mkdtemp(prefix="watchkeep-unread-")
    save = lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch}")
    unread_counts(live.where("not is_mark"), live.where("is_mark")).writeStream.outputMode("update").trigger(
        availableNow=True).foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    table, seen = spark.read.parquet(f"{folder}/counts"), []
    for batch in range(len(rows)):
        seen.append(unread_now(table.where(F.col("batch") <= batch)).first()["unread"])
    assert seen == [1, 2, 1, 2, 2, 3, 2, 2]


def test_live_buffer_in_a_stream(spark):
    stream = dripping(spark, [(i, s) for i, s in enumerate([5, 3, 9, 1, 7])], "log_id long, s long")
    folder = tempfile.mkdtemp(prefix="watchkeep-buffer-")
    buffer = LiveBuffer(spark, f"{folder}/buffer", 3)
    live = stream.select("log_id", F.timestamp_seconds("s").alias("created_at"))
    buffer.start(live, f"{folder}/checkpoint", available_now=True).awaitTermination()
    assert sorted(r["log_id"] for r in buffer.table().collect()) == [0, 2, 4]
    buffer.process(spark.createDataFrame([(9, 100)], "log_id long, s long").select("log_id", F.timestamp_seconds("s").alias("created_at")), 5)
    buffer.process(spark.createDataFrame([(9, 100)], "log_id long, s long").select("log_id", F.timestamp_seconds("s").alias("created_at")), 5)
    assert sorted(r["log_id"] for r in buffer.table().collect()) == [2, 4, 9]


def test_envelope_round_trip(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "id long, title string, note string")
    back = opened(envelope(rows, "incident"), "type string, data struct<id: bigint, title: string, note: string>")
    assert sorted(map(tuple, back.collect())) == [("incident", 1, "a", None), ("incident", 2, "b", "c")]
    with pytest.raises(ValueError):
        envelope(rows, "other")


def test_live_buffer_trims(spark, small):
    logs = derived(spark, small, "logs").select("log_id", "created_at")
    old, new = logs.where("log_id < 700"), logs.where("log_id >= 700")
    kept = trimmed(trimmed(old.limit(0), old, 500), new, 500)
    assert sorted(r.log_id for r in kept.collect()) == list(range(500, 1000))
