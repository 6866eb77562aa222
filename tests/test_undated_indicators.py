"""Indicators without a time."""

from pyspark.sql import functions as F

from watchkeep.operators import intel


def test_indicators_without_a_time_count_as_the_oldest(spark):
    rows = [("1", "10.0.0.1", None, 70), ("2", "10.0.0.1", None, 80), ("3", "10.0.0.2", None, 60), ("2", "10.0.0.2", "2024-01-01", 90)]
    found = spark.createDataFrame(rows, "ioc_id string, value string, at string, confidence int").select(
        "ioc_id", "value", "confidence", F.col("at").cast("timestamp").alias("created_at"), F.lit("ip").alias("ioc_type"),
        F.array(F.lit("t")).alias("tags"))
    ips = spark.createDataFrame([("10.0.0.1",), ("10.0.0.2",), ("10.0.0.3",)], "ip string")
    by = {r["ip"]: r for r in intel.ip_reputation(ips, found, intel.feed(spark, ["10.9.9.9"], "ip")).collect()}
    assert by["10.0.0.1"]["ioc_match"] and by["10.0.0.1"]["risk_score"] == 80
    assert by["10.0.0.2"]["ioc_match"] and by["10.0.0.2"]["risk_score"] == 90
    assert not by["10.0.0.3"]["is_malicious"]
