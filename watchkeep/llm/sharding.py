"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window, functions as F

from watchkeep.llm.common import store

RING_SEED, KEY_SEED, PART_SEED = 81, 82, 83
CELLS = 1 << 16
ROWS_PER_PART = 20_000


def ring_points(spark, shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; there are shards x nodes of them."""
    both = spark.range(shards * nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    placed = both.select(F.pmod(F.xxhash64(F.lit(RING_SEED), "shard", "node"), F.lit(CELLS)).cast("int").alias("at"), "shard")
    return sorted((r["at"], r["shard"]) for r in placed.collect())


def ring_cells(spark, points: list[tuple[int, int]]) -> DataFrame:
    """The arc of every cell: the first virtual node clockwise from it."""
    places = [p for p, _ in points]
    rows = [(c, bisect.bisect_left(places, c) % len(places)) for c in range(CELLS)]
    return spark.createDataFrame(rows, "cell int, arc int")


def fill(points: list[tuple[int, int]], loads: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot): who takes which keys of an arc.

    Every shard holds n // shards keys, and the first n % shards on the ring
    one more.  Keys of an arc go to its virtual node's shard; what it has no
    room for continues clockwise to the next shard with room.
    """
    n = sum(loads.values())
    order = list(dict.fromkeys(s for _, s in points))
    room = {s: n // shards + (i < n % shards) for i, s in enumerate(order)}
    slot = dict.fromkeys(order, 0)
    pieces, waiting = [], []
    # Own keys first, then what overflows, so that only the excess moves.
    for arc, (_, shard) in enumerate(points):
        held = loads.get(arc, 0)
        taken = min(held, room[shard])
        if taken:
            pieces.append((arc, 0, taken, shard, slot[shard]))
            room[shard] -= taken
            slot[shard] += taken
        if held > taken:
            waiting.append((arc, taken, held))
    for arc, begin, end in waiting:
        at = arc
        while begin < end:
            at = (at + 1) % len(points)
            shard = points[at][1]
            taken = min(end - begin, room[shard])
            if taken:
                pieces.append((arc, begin, begin + taken, shard, slot[shard]))
                room[shard] -= taken
                slot[shard] += taken
                begin += taken
    return pieces


def bounded_ring(docs: DataFrame, shards: int = 40, nodes: int = 32, key: str = "doc_id") -> DataFrame:
    """``docs`` (key, text) in shards whose row counts differ by one at most.

    A key's place on the ring is a hash of the key alone.  Keys of an arc are
    ranked by a second hash; what its shard cannot hold continues clockwise.
    Only shards x nodes counts reach the driver; ranks are made in parts of
    about 20,000 rows, and rows of one key are dealt over parts, so a key with
    a third of all rows has no part of its own.

    Null keys are one key; null and empty texts have size 16 and crc32 0;
    repeated rows each take a place; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = store(docs.select(
        F.col(key).alias("key"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    ), "ring")
    points = ring_points(spark, shards, nodes)
    name = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    parts = max(1, base.count() // (ROWS_PER_PART * len(points)) + 1)
    keyed = base.select(
        "*", F.pmod(F.xxhash64(F.lit(KEY_SEED), name), F.lit(CELLS)).cast("int").alias("cell"),
        F.xxhash64(F.lit(PART_SEED), name, "row").alias("order"),
    ).withColumn("part", F.pmod("order", F.lit(parts)))
    # Fixed size: one row per cell of the ring.
    placed = keyed.join(F.broadcast(ring_cells(spark, points)), "cell").drop("cell")
    loads = store(placed.groupBy("arc", "part").agg(F.count("*").alias("n")), "ring-loads")
    per_arc = {r["arc"]: r["n"] for r in loads.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    pieces = spark.createDataFrame(
        fill(points, per_arc, shards), "arc int, begin long, end long, shard int, slot_begin long")
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    skipped = loads.select("arc", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    inside = Window.partitionBy("arc", "part").orderBy("order", "row")
    ranked = placed.withColumn("place", F.row_number().over(inside) - 1).join(skipped, ["arc", "part"]).withColumn(
        "rank", F.col("skipped") + F.col("place")).alias("r")
    p = F.broadcast(pieces).alias("p")  # a few rows per virtual node
    hit = (F.col("r.arc") == F.col("p.arc")) & (F.col("r.rank") >= F.col("p.begin")) & (F.col("r.rank") < F.col("p.end"))
    return ranked.join(p, hit).select(
        F.col("r.key").alias(key), "size", "text_crc32", "shard",
        (F.col("slot_begin") + F.col("rank") - F.col("begin")).alias("slot"),
        (F.element_at(F.array(*[F.lit(s) for _, s in points]), F.col("r.arc") + 1) != F.col("shard")).alias("moved"),
    )
