"""Pages at any depth and the keyword index, against plain sorts and scans."""

import random

import pytest
from pyspark.sql import functions as F

from watchkeep.operators import filters, pages
from watchkeep.operators.keyword_index import KeywordIndex


@pytest.fixture(scope="module")
def rows(spark):
    make = random.Random(3)
    data = [(make.choice([None, 5, make.randrange(1000)]), make.choice([None, "a", "é", f"k{make.randrange(50)}"]), i) for i in range(6000)]
    data += [(5, "a", 100_000)] * 40  # equal rows
    df = spark.createDataFrame(data, "n long, s string, id long").withColumn("t", F.timestamp_seconds(F.col("n")))
    return df.repartition(4).cache()


def plain(df, by, descending, skip, limit):
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in by]
    return df.orderBy(*order).offset(skip).limit(limit).collect()


@pytest.mark.parametrize("descending, skip, limit", [
    (True, 0, 10), (False, 1990, 40), (True, 3000, 100), (False, 5990, 100), (True, 7000, 5), (False, 2500, 900)])
def test_page_equals_a_plain_sort(rows, descending, skip, limit):
    by = ["t", "s", "id"]
    found = pages.deep_page(rows, by, descending, skip, limit, few=150).collect()
    assert found == plain(rows, by, descending, skip, limit)


def test_pages_of_ties_do_not_overlap(rows):
    """A third of all rows have one value; pages of ten go through them all once."""
    few = rows.where("n = 5").drop("t")
    total = few.count()
    seen = [r["id"] for skip in range(0, total, 700) for r in pages.deep_page(few, ["n"], True, skip, 700, few=100).collect()]
    assert sorted(seen) == sorted(r["id"] for r in few.collect())


def test_plan_has_no_prefix_sized_limit(rows):
    page = pages.deep_page(rows, ["t", "s", "id"], True, 4000, 20, few=100)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    numbers = [int(w) for w in plan.replace("(", " ").replace(",", " ").split() if w.isdigit()]
    assert 4020 not in numbers and 4000 not in numbers


def test_bounds_reach_the_reader(rows, tmp_path, spark):
    rows.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    page = pages.deep_page(stored, ["n", "id"], True, 1200, 20, few=100)
    assert "GreaterThanOrEqual(n," in page._jdf.queryExecution().executedPlan().toString().replace("EqualTo", "EqualTo")


def test_deep_searches_use_it(rows):
    """Beyond what one task may sort, pages of searches come from order statistics."""
    many = rows.sparkSession.range(40_000).select(
        F.col("id").alias("log_id"), F.timestamp_seconds(F.col("id") % 977).alias("created_at"), F.lit("x").alias("message"))
    assert filters.newest(many, 30, skip=25_000).collect() == plain(many, ["created_at", "log_id"], True, 25_000, 30)
    found = filters.counted_page(many, "log_id", 25_000, 30).collect()
    assert [r["log_id"] for r in found] == [r["log_id"] for r in plain(many, ["created_at", "log_id"], True, 25_000, 30)]
    assert {r["total"] for r in found} == {40_000}
    assert [tuple(r) for r in filters.counted_page(many, "log_id", 50_000, 30).collect()] == [(None, None, None, 40_000)]


WORDS = ["PowerShell", "Ärger", "漢字", "host-1", "x", "", "ab", "Σίσυφος", "\x00odd", "İstanbul", "🐍 snake"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    make = random.Random(8)
    text = lambda: " ".join(make.choice(WORDS + [str(make.randrange(10_000))]) for _ in range(make.randrange(4)))
    data = [(i, make.choice([None, text()]), text(), make.choice(["WEB", "é", None]), "10.0.0.1") for i in range(4000)]
    data[2500] = (2500, "a needle here", None, None, None)
    df = spark.createDataFrame(data, "log_id long, message string, raw_log string, hostname string, source_ip string")
    index = KeywordIndex(spark, str(tmp_path_factory.mktemp("index")), group_rows=16)
    index.append(df.where("log_id < 3000").repartitionByRange(3, "log_id"), "first")
    index.append(df.where("log_id >= 3000").coalesce(1), "7")
    return df.cache(), index


@pytest.mark.parametrize("word", ["powershell", "NEEDLE", "är", "ä", "漢", "漢字", "host-1 x", "zzz", "s", "\x00o", "1", "12", "123", "1234", "συφ", "web", "", "🐍", "🐍 s", "10.0.0.1"])
def test_index_finds_what_a_scan_finds(stored, word):
    df, index = stored
    found = sorted(r["log_id"] for r in index.search(word).collect())
    assert found == sorted(r["log_id"] for r in df.where(filters.keyword(word)).collect())


def test_rare_words_read_few_row_groups(stored):
    _, index = stored
    assert 0 < index.share("needle") < 0.01 and index.share("10.0.0.1") > 0.95 and index.share("zzzz") == 0
    plan = index.search("needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(row," in plan


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path))
    df = spark.createDataFrame([("m", "r", "h", "1")], "message string, raw_log string, hostname string, source_ip string")
    index.append(df, "one")
    index.append(df, "one")
    assert index.search("m").count() == 1 and index.search("R").columns == df.columns
