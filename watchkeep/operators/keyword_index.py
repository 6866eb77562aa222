"""Keyword search over stored logs through an index of trigrams.

Rows are stored in row groups of equal length.  Posting lists say for every
trigram, and every segment of 64 row groups of a file, which groups hold it, as
the bits of one number: lists are built by ``bit_or``, intersected by ``bit_and``.
A search reads the lists of a word's rarest trigrams, then only the row groups
that are left, and looks for the word itself there; so it finds what a scan finds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchkeep.functions.text import text
from watchkeep.operators.filters import KEYWORD_FIELDS, keyword

GROUP_ROWS = 4096
GROUPS = 64  # row groups of a segment, the bits of a long
ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits
MOST_LISTS = 6  # trigrams of a word that are looked up
WORTH = 16  # a list this many times longer than the shortest is not read
MOST_RANGES = 64  # row groups named one by one in the filter that reaches the reader
MOST_PARTS = 10_000  # files named in it
MOST_SEGMENTS = 500_000  # rows of the table of segments that may be broadcast
PAD = "\x00\x00"  # so that a trigram begins at every character


def trigrams(fields: list[str]) -> Column:
    """Distinct trigrams of the lower-cased fields; the last characters are filled up."""
    overlapping = F.lit(r"(?s)(?=(...))")
    return F.array_distinct(F.flatten(F.array(*[
        F.regexp_extract_all(F.concat(F.lower(text(f)), F.lit(PAD)), overlapping, F.lit(1)) for f in fields])))


@dataclass
class KeywordIndex:
    """Stored rows and posting lists under ``folder``; rows come in batches, each indexed when it is written."""

    spark: SparkSession
    folder: str
    fields: tuple[str, ...] = tuple(KEYWORD_FIELDS)
    group_rows: int = GROUP_ROWS

    def append(self, df: DataFrame, batch: str | None = None) -> None:
        """Store and index the rows of ``df``; a batch written again replaces itself."""
        batch = batch or uuid.uuid4().hex
        rows = f"{self.folder}/rows/batch={batch}"
        numbered = df.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))})
        numbered.write.mode("overwrite").partitionBy("part").option("parquet.block.row.count.limit", self.group_rows).parquet(rows)
        stored = self.spark.read.parquet(rows)
        held = stored.select("part", "row", F.explode(trigrams(list(self.fields))).alias("gram"))
        segment, bit = self._place()
        lists = held.groupBy("gram", "part", segment.alias("segment")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("groups"))
        lists.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part", "segment").write.mode("overwrite").parquet(
            f"{self.folder}/lists/batch={batch}")
        lists = self.spark.read.parquet(f"{self.folder}/lists/batch={batch}")
        sizes = lists.groupBy("gram").agg(F.sum(F.bit_count("groups")).alias("n"))
        # Written last: a batch counts as there once its sizes are.
        sizes.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.folder}/sizes/batch={batch}")

    def _place(self) -> tuple[Column, Column]:
        """Segment of a row in its file, and its row group there."""
        group = F.floor(F.col("row") / self.group_rows)
        return F.floor(group / GROUPS).cast("int"), (group % GROUPS).cast("int")

    def _table(self, name: str) -> DataFrame:
        # Batches may look like numbers.
        schema = self.spark.read.parquet(f"{self.folder}/{name}").schema
        kinds = ", ".join(f"`{f.name}` {'string' if f.name == 'batch' else f.dataType.simpleString()}" for f in schema)
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/{name}")

    def _sizes(self) -> DataFrame:
        return self._table("sizes").groupBy("gram").agg(F.sum("n").alias("n"))

    def segments(self, word: str) -> DataFrame:
        """(batch, part, segment, groups): row groups that may hold the word, as bits."""
        low = word.lower()
        lists = self._table("lists")
        where = ["batch", "part", "segment"]
        if len(low) < 3:
            # Every place of the word begins a trigram that begins with it.
            return lists.where(F.col("gram").startswith(low)).groupBy(*where).agg(F.bit_or("groups").alias("groups"))
        grams = list(dict.fromkeys(low[i: i + 3] for i in range(len(low) - 2)))
        sizes = {r["gram"]: r["n"] for r in self._sizes().where(F.col("gram").isin(grams)).collect()}
        rare = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:MOST_LISTS]
        least = sizes.get(rare[0], 0)
        read = [g for g in rare if sizes.get(g, 0) <= WORTH * least] if least else rare[:1]
        return lists.where(F.col("gram").isin(read)).groupBy(*where).agg(
            F.bit_and("groups").alias("groups"), F.count("*").alias("n")).where((F.col("n") == len(read)) & (F.col("groups") != 0)).drop("n")

    def share(self, word: str) -> float:
        """Share of all row groups that a search for the word reads."""
        known = self._table("lists").groupBy("batch", "part", "segment").agg(F.bit_or("groups").alias("groups"))
        bits = lambda df: df.agg(F.coalesce(F.sum(F.bit_count("groups")), F.lit(0)).alias("n")).head()["n"]
        return bits(self.segments(word)) / max(1, bits(known))

    def search(self, word: str) -> DataFrame:
        """Rows with the word in any field, in any case; as ``keyword`` finds them."""
        rows = self._table("rows")
        columns = [c for c in rows.columns if c not in ("batch", "part", "row")]
        if not word:
            return rows.where(keyword(word, list(self.fields))).select(*columns)
        found = self.segments(word)
        figures = found.agg(F.count("*").alias("segments"), F.sum(F.bit_count("groups")).alias("groups")).head()
        if not figures["segments"]:
            return rows.limit(0).select(*columns)
        if figures["groups"] <= MOST_RANGES:
            rows = rows.where(reduce(Column.__or__, [self._range(r, bit) for r in found.collect() for bit in _bits(r["groups"])]))
        elif figures["segments"] <= MOST_SEGMENTS:
            files = found.select("batch", "part").distinct()
            if files.count() <= MOST_PARTS:
                by_batch: dict[str, list[int]] = {}
                for r in files.collect():
                    by_batch.setdefault(r["batch"], []).append(r["part"])
                rows = rows.where(reduce(Column.__or__, [(F.col("batch") == b) & F.col("part").isin(p) for b, p in by_batch.items()]))
            segment, bit = self._place()
            placed = rows.withColumns({"segment": segment, "bit": bit})
            rows = placed.join(F.broadcast(found), ["batch", "part", "segment"]).where(F.expr("getbit(groups, bit) = 1"))
        return rows.where(keyword(word, list(self.fields))).select(*columns)

    def _range(self, at, bit: int) -> Column:
        first = (at["segment"] * GROUPS + bit) * self.group_rows
        return (F.col("batch") == at["batch"]) & (F.col("part") == at["part"]) & F.col("row").between(first, first + self.group_rows - 1)


def _bits(groups: int) -> list[int]:
    return [b for b in range(GROUPS) if groups >> b & 1]
