"""Fill-in-middle texts, cut at line ranks that an indexable skip list finds."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from watchkeep.llm.common import U64, GOLDEN, arrow, mix

# Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MOST_LANES = 24
OUTPUT_CHARS = 32_000_000
OUTPUT = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
_heights = np.zeros(0, np.int8)


def heights(n: int) -> np.ndarray:
    """Lanes that each of n nodes takes part in above the lowest: one more with chance 1/4, by a hash of the place."""
    global _heights
    if len(_heights) < n:
        bits = mix(np.arange(max(n, 1 << 14), dtype=U64) * GOLDEN)
        tall = np.zeros(len(bits), np.int8)
        for lane in range(1, MOST_LANES + 1):
            tall += (bits & U64((1 << 2 * lane) - 1)) == 0
        _heights = tall
    return _heights[:n]


class SkipList:
    """Units in order, found by rank.

    A node stands before every unit.  In each lane a node's link carries two
    widths: the units and the code points up to the next node of that lane.
    Widths of a lane are sums of the widths of the lane below, and the first
    node is in every lane.
    """

    def __init__(self, chars: np.ndarray):
        units, nodes, tall = np.ones(len(chars), np.int64), np.arange(len(chars)), heights(len(chars))
        self.lanes = [(units.tolist(), chars.tolist(), None)]
        for lane in range(MOST_LANES):
            kept = tall[nodes] > lane
            kept[:1] = True
            down = np.flatnonzero(kept)
            if len(down) < 2:
                break
            units, chars, nodes = np.add.reduceat(units, down), np.add.reduceat(chars, down), nodes[down]
            self.lanes.append((units.tolist(), chars.tolist(), down.tolist()))

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units, with about 4 log4(n) steps."""
        node = units = chars = 0
        for width_units, width_chars, down in reversed(self.lanes):
            while node < len(width_units) and units + width_units[node] <= rank:
                units += width_units[node]
                chars += width_chars[node]
                node += 1
            if units == rank:
                return chars
            if down is not None:
                node = down[node]
        return chars


def line_lengths(text: str) -> np.ndarray:
    """Code points of every line, its line feed included."""
    lengths = np.array([len(line) + 1 for line in text.split("\n")], np.int64)
    lengths[-1] -= 1
    return lengths if lengths[-1] else lengths[:-1]


def _cut(batch: pa.RecordBatch, rate: int, spm: int):
    texts, draws = batch.column("text"), [batch.column(f"h{i}").to_pylist() for i in range(1, 5)]
    begin, held, rows = 0, 0, []
    for i, (h1, h2, h3, h4) in enumerate(zip(*draws)):
        text = texts[i].as_py()
        lengths = line_lengths(text)
        n, first, last, form, output = len(lengths), None, None, "plain", text
        if text and h3 % 100 < rate and PREFIX not in text and SUFFIX not in text and MIDDLE not in text:
            ranks, lines = sorted((h1 % (n + 1), h2 % (n + 1))), SkipList(lengths)
            first, last = map(lines.chars_before, ranks)
            head, body, tail = text[:first], text[first:last], text[last:]
            if h4 % 100 < spm:
                form, output = "spm", f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{body}"
            else:
                form, output = "psm", f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{body}"
        rows.append((n, form, first, None if first is None else last - first, output))
        held += len(output)
        if held > OUTPUT_CHARS:
            yield _columns(batch, begin, rows)
            begin, held, rows = i + 1, 0, []
    if rows:
        yield _columns(batch, begin, rows)


def _columns(batch: pa.RecordBatch, begin: int, rows: list[tuple]) -> dict[str, pa.Array]:
    return {"key": batch.column("key").slice(begin, len(rows)), **{
        name: pa.array(values, kind) for (name, kind), values in zip(OUTPUT, zip(*rows))}}


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for every row of ``docs`` (key, text).

    Both cuts lie between lines, at ranks drawn from the sha256 of seed and
    key; ``rate`` percent of the documents are cut, ``spm`` percent of those
    begin with the suffix.  Texts that hold a mark stay plain.

    Null texts are empty, empty ones plain with n = 0; a null key draws as the
    empty string; equal keys draw alike, and every row gives one row; very long
    texts are handled whole, one at a time; an empty table gives no rows;
    other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    kind = docs.schema[key].dataType.simpleString()
    taken = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *draws)
    cut = arrow(
        lambda batch: _cut(batch, rate, spm), taken,
        f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return cut.withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of, from output and form alone.

    Marks occur in a cut output only where they were put: no mark has a prefix
    that ends another one, so parts and marks make none together.
    """
    parts = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    at = lambda *places: F.concat(*[F.get(parts, F.lit(p)) for p in places])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)
