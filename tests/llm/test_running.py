"""Running sums and exclusive ors against plain loops, with keys over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from watchkeep.llm.common import prepare
from watchkeep.llm.running import running


def brute(rows):
    out, sums = [], {}
    for key, at, value in sorted(rows):
        s, x = sums.get(key, (0, 0))
        out.append((key, at, value, s, x))
        sums[key] = (s + value, x ^ value)
    return out


@pytest.mark.parametrize("hot", [0, 400])
def test_sums_cross_task_edges(spark, hot):
    prepare(spark).conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    make = random.Random(hot)
    rows = [(make.choice([-7, 1, 2, 3]), i, make.getrandbits(20)) for i in range(300)] + [(2, 1000 + i, i) for i in range(hot)]
    try:
        df = spark.createDataFrame(rows, "k long, at long, v long").withColumn("extra", F.array("v"))
        found = running(df, "k", ["at"], ["v"], []).join(
            running(df, "k", ["at"], [], ["v"]).select("k", "at", F.col("v_before").alias("x")), ["k", "at"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r["k"], r["at"], r["v"], r["v_before"], r["x"]) for r in found) == brute(rows)
    assert all(r["extra"] == [r["v"]] for r in found)


def test_an_empty_table_has_no_sums(spark):
    prepare(spark)
    assert running(spark.createDataFrame([], "k long, at long, v long"), "k", ["at"], ["v"]).count() == 0
