"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from watchkeep.llm.common import WORD, prepare, store
from watchkeep.llm.running import running

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 512
# Points of the golden-ratio sequence as 31-bit fractions: the odd number next to 2**31 / golden ratio.
POINTS, STEP = 1 << 31, 1327217885
LAST = (1 << 63) - 1


def measure(docs: DataFrame, key: str) -> DataFrame:
    """(row, key, source, size): every document with its words, without its text."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    return store(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col("source").cast("string").alias("source"),
        words.cast("long").alias("size")), "measured")


def targets(measured: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(number, source, source_size, target, quota): what each source is to give.

    Sources share ``percent`` of all words by weight, up to ``most`` times their
    own size.  Sorted by the level at which they are full, the level of all
    others follows from two running sums, without rounds of resharing.  Quota
    is the target in whole words.
    """
    spark = measured.sparkSession
    sizes = store(measured.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", F.col("source").isNull().cast("int").alias("last"), "source_size",
        *[F.lit(v).cast("long").alias(n) for v, n in ((0, "all"), (1, "one"))]), "sources")
    numbered = running(sizes, "all", ["last", "source"], ["one"], name="numbered")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    weighed = store(numbered.select(
        "all", F.col("one_before").alias("number"), "source", "source_size", weight.alias("weight"),
        (F.col("source_size") * most).alias("cap")).withColumn("full_at", F.col("cap") / F.col("weight")), "weighed")
    whole = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).head()
    budget, weights_sum = (whole["words"] or 0) * percent / 100, whole["weights"] or 0
    sums = running(weighed, "all", ["full_at", "number"], ["cap", "weight"], name="levels")
    level = (F.lit(budget) - F.col("cap_before")) / (F.lit(weights_sum) - F.col("weight_before"))
    # Sources are full up to the first that the level of all from it on does not fill; later levels are lower.
    found = sums.select(level.alias("level"), "full_at").where("full_at >= level").agg(F.max("level").alias("level")).head()["level"]
    share = F.col("weight") * F.lit(float(found)) if found is not None else F.col("cap").cast("double")
    target = F.least(F.col("cap").cast("double"), share)
    return store(weighed.select(
        "number", "source", "source_size", target.alias("target"), F.round(target).cast("long").alias("quota")), "targets")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(position, number, block): which block of which source comes at which place of the mix.

    Place n has the point n * golden ratio modulo 1; cumulative quotas map it to
    a source, and a source's places are ranked: the i-th takes block i.  Any
    stretch of the mix therefore holds every source near its share.  There are
    as many places as blocks; a source may get a few more or less than it has.
    """
    spark = sources.sparkSession
    cumulated = running(
        sources.select("number", "quota", F.lit(0).cast("long").alias("all")), "all", ["number"], ["quota"], name="cumulated")
    sums = sources.agg(F.sum(F.ceil(F.col("quota") / block)).cast("long").alias("places"), F.sum("quota").alias("words")).head()
    places, words = sums["places"] or 0, sums["words"] or 0
    # A source's interval begins at its edge; edges are sorted among the points, before places with
    # the same point, and how many lie before a place tells its source.
    edges = cumulated.select(
        F.lit(0).cast("long").alias("all"), F.ceil(F.col("quota_before") / max(1, words) * POINTS).cast("long").alias("point"),
        F.lit(-1).cast("long").alias("place"), F.lit(1).cast("long").alias("edge"))
    slots = spark.range(places).select(
        F.lit(0).cast("long").alias("all"), ((F.col("id") % POINTS) * STEP % POINTS).alias("point"),
        F.col("id").alias("place"), F.lit(0).cast("long").alias("edge"))
    mapped = running(edges.unionByName(slots), "all", ["point", "place"], ["edge"], name="mapped").where("place >= 0").select(
        (F.col("edge_before") - 1).alias("number"), "place", F.lit(1).cast("long").alias("one"))
    return running(mapped, "number", ["place"], ["one"], name="ranked").select(
        F.col("place").alias("position"), "number", F.col("one_before").alias("block"))


def shuffled_spans(tagged: DataFrame, epochs: int) -> DataFrame:
    """(number, epoch, row, quota, begin, end): where each document lies in its source's stream of words.

    A source's stream is its documents in hashed order, then once more in another order.
    """
    turns = tagged.where("size > 0").select(
        "number", "row", "key", "size", "source_size", "quota", F.explode(F.array(*[F.lit(e).cast("long") for e in range(epochs)])).alias("epoch"))
    needed = turns.where("epoch * source_size < quota").select(
        "number", "row", "size", "epoch", "quota",
        F.md5(F.concat(F.col("epoch").cast("string"), F.lit(":"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary")).alias("dealt"))
    streams = running(needed, "number", ["epoch", "dealt", "size", "row"], ["size"], name="streams")
    return streams.select("number", "epoch", "row", "quota", F.col("size_before").alias("begin"), (F.col("size_before") + F.col("size")).alias("end"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2,
            block: int = BLOCK_WORDS, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The mix, and its account: every document with what the mix takes of it.

    The first table is (position, number, block, row, epoch, first, words): at
    ``position`` of the mix (LAST: after all others) stand ``words`` words of document ``row`` from its
    word ``first`` on; a block of ``block`` words holds pieces of consecutive
    documents of its source's shuffled stream.  The second is (row, key, size,
    source, source_size, target, taken).

    A null source is a source, after all others; null and empty texts have no
    words and take no part; documents of one key and size are ordered by row,
    which only tells equal ones apart; a text of any length is cut
    into blocks; an empty table gives an empty mix; other columns are not read.
    """
    prepare(docs.sparkSession)
    held = measure(docs, key)
    sources = targets(held, weights, percent, most)
    of = sources.withColumnRenamed("source", "of")
    tagged = store(held.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "tagged")
    spans = shuffled_spans(tagged, most).where("begin < quota").withColumn("stop", F.least("end", "quota"))
    pieces = store(spans.select(
        "number", "epoch", "row", "begin", "stop",
        F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("stop") - 1) / block))).alias("block")), "pieces")
    first, stop = F.greatest("begin", F.col("block") * block), F.least("stop", (F.col("block") + 1) * block)
    # Blocks without a place come at the end, so that exactly the quotas are taken.
    mix = store(pieces.join(schedule(sources, block), ["number", "block"], "left").select(
        F.coalesce("position", F.lit(LAST)).alias("position"), "number", "block", "row", "epoch",
        (first - F.col("begin")).alias("first"), (stop - first).alias("words")), "mix")
    taken = store(mix.groupBy("row").agg(F.sum("words").alias("taken")), "taken")
    account = tagged.join(taken, "row", "left").select(
        "row", "key", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return mix, account.withColumnRenamed("key", key)
