"""Rules of one's own, unique ids, newest and first by time, totals of empty pages."""

import pytest
from pyspark.sql import functions as F

from watchkeep.operators import filters, intel, updates
from watchkeep.operators.thresholds import Threshold
from watchkeep.plans.detection import all_alerts
from watchkeep.plans.rules import Rule
from watchkeep.schemas import LOGS
from watchkeep.sources.tables import append
from watchkeep.streaming.ingest import Ingest


def logs_of(spark, count=3, **values):
    rows = spark.range(count).select(F.col("id").alias("log_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("created_at"))
    named = {k: F.lit(v) for k, v in values.items()}
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else named.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in LOGS])


def rule(name, threshold=None, title=None):
    key = F.col("hostname") if threshold else None
    return Rule(name=name, severity="low", techniques=[], tags=["t"], when=F.col("hostname") == "h",
                title=title if title is not None else F.lit("x"), description=F.lit("d"), threshold=threshold, key=key)


COUNT = Threshold(count=3, seconds=10)


def test_rules_read_whole_texts(spark):
    logs = logs_of(spark, hostname="h", raw_log="r" * 500)
    length = F.length("raw_log").cast("string")
    found = all_alerts(logs, [rule("one", title=length), rule("three", COUNT, length)]).collect()
    assert {r.title for r in found} == {"500"} and len(found) == 4
    assert {len(r.raw_log_snippet) for r in found} == {200}


def test_names_with_colons_and_equal_names(spark):
    logs = logs_of(spark, hostname="h")
    assert {r.rule_name for r in all_alerts(logs, [rule("a:b", COUNT), rule("a", COUNT)]).collect()} == {"a:b", "a"}
    with pytest.raises(ValueError, match="differ"):
        all_alerts(logs, [rule("a"), rule("a", COUNT)])


def test_no_rules_give_no_alerts(spark):
    assert all_alerts(logs_of(spark, hostname="h"), []).count() == 0


@pytest.mark.parametrize("rules", [[rule], [lambda n: rule(n, COUNT)], [rule, lambda n: rule(n, COUNT)]])
def test_ingest_takes_any_kinds_of_rules(spark, tmp_path, rules):
    job = Ingest(spark, str(tmp_path / "tables"), [make(f"r{i}") for i, make in enumerate(rules)])
    logs = logs_of(spark, hostname="h")
    job.process(logs, 0)
    job.finish(logs.schema)
    names = {r.rule_name for r in job.table("alerts").collect()}
    assert names == {f"r{i}" for i in range(len(rules))}


def test_logs_without_a_time_are_late_and_whole(spark, tmp_path):
    job = Ingest(spark, str(tmp_path / "tables"), [rule("r", COUNT)])
    logs = logs_of(spark, hostname="h", raw_log="r" * 500).withColumn("created_at", F.when(F.col("log_id") > 0, F.col("created_at")))
    job.process(logs, 0)
    late = job.table("late").collect()
    assert [r.log_id for r in late] == ["0"] and len(late[0].raw_log) == 500


def test_newest_indicator_and_first_match_by_time(spark):
    rows = [("ffff", "1.1.1.1", 1, 11), ("0000", "1.1.1.1", 2, 99)]
    found = spark.createDataFrame(rows, "ioc_id string, value string, t long, confidence int").select(
        "*", F.lit("ip").alias("ioc_type"), F.timestamp_seconds("t").alias("created_at"), F.array(F.lit("a")).alias("tags"))
    assert intel.newest_indicators(found, "ip").first().ioc.confidence == 99
    changed = updates.update_one(found, {"ioc_type": "ip"}, {"confidence": 0}, "ioc_id")
    assert {r.ioc_id: r.confidence for r in changed.collect()} == {"ffff": 0, "0000": 99}


def test_empty_pages_keep_the_total(spark):
    found = logs_of(spark, 5, message="hello")
    assert [(r.log_id, r.total) for r in filters.search_logs(found, skip=100).collect()] == [(None, 5)]
    assert [(r.log_id, r.total) for r in filters.search_logs(found, word="nothing").collect()] == [(None, 5)]


def test_equal_rows_get_ids_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([("m",), ("m",)], "message string")
    append(rows, str(tmp_path / "t"), "log_id")
    assert spark.read.parquet(str(tmp_path / "t")).select("log_id").distinct().count() == 2
