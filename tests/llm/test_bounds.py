"""Samples that stay inside their bounds, and joins that a hot key does not hold up."""

from pyspark.sql import functions as F

from watchkeep.llm.common import prepare, store
from watchkeep.llm.labelled import labelled_sample


def test_an_id_with_many_rows_is_one_row_of_the_sample(spark):
    prepare(spark)
    docs = spark.range(3000).select(F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.createDataFrame([(7, 1), (7, 1), (2600, 0), (2700, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    found = labelled_sample(docs, labels, "toxic", F.lit(False), 100).collect()
    assert sorted((r["key"], r["text"], r["label"]) for r in found) == [(7, "t0", 1), (2600, "t2600", 0)]


def test_characters_are_bounded(spark):
    prepare(spark)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', if(id = 3, 500000, 100))").alias("text"))
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    sample = labelled_sample(docs, labels, "toxic", F.lit(False), 5000, chars=40_000)
    found = sample.agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows")).head()
    assert 0 < found["n"] <= 40_000 and found["rows"] < 200
    assert labelled_sample(docs.limit(0), labels, "toxic", F.lit(False), 10).count() == 0


def test_a_stored_aggregate_lets_a_hot_join_be_split(spark):
    """The pattern of the hub joins: both sides are read from tables."""
    prepare(spark)
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20k"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        rows = store(spark.range(60_000).repartition(8).select(F.when(F.col("id") % 20 > 0, 1).otherwise(F.col("id")).alias("hub"), F.xxhash64("id").alias("v")), "rows")
        sizes = store(rows.groupBy("hub").agg(F.count("*").alias("n")), "sizes")
        kept = rows.join(sizes, "hub").agg(F.max("n").alias("n"))
        assert kept.collect()[0]["n"] == 57_000
        assert "skew" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
