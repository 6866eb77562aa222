"""Benchmark passages in documents: q-gram lemma filter and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from watchkeep.llm.common import U64, arrow, mix, powers, text_or_empty

Q = 10
# Edits allowed, as a share of a passage's normalised length.
EDIT_SHARE = 0.07
# Normalised characters of passages that one pass over the documents takes.
BLOCK_CHARS = 4_000_000
CHUNK_CHARS = 1_000_000
_TABLE_BITS = 24


def _fold() -> np.ndarray:
    """Lower case of every character, and 32 for those that are neither letter nor digit."""
    out = np.full(0x110000, 32, np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x110000)]:
        letter = chr(c)
        if letter.isalnum():
            low = letter.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_cache: dict = {}


def normalised(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters with single blanks, none at a text's ends, and where each text begins."""
    if "fold" not in _cache:
        _cache["fold"] = _fold()
    folded = _cache["fold"][codes]
    blank = folded == 32
    follows = np.ones(len(folded), bool)
    follows[1:] = blank[:-1]
    follows[offsets[:-1][offsets[:-1] < len(folded)]] = True
    keep = ~(blank & follows)
    # A blank that ends a text goes too.
    last = np.ones(len(folded), bool)
    kept = np.flatnonzero(keep)
    counts = np.searchsorted(kept, offsets)
    ends = counts[1:][np.diff(counts) > 0] - 1
    tail = kept[ends]
    last[tail[blank[tail]]] = False
    keep &= last
    starts = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return folded[keep], starts


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each place."""
    if len(codes) < Q:
        return np.zeros(0, U64)
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * up[: len(codes)], out=total[1:])
    return mix((total[Q:] - total[:-Q]) * down[: len(codes) - Q + 1])


class Passages:
    """The q-grams of a block of passages, and how many edits each may have."""

    def __init__(self, ids: list[int], texts: list[str]):
        codes, offsets = code_points(texts)
        flat, starts = normalised(codes, offsets)
        self.ids = np.array(ids, np.int64)
        self.codes = [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.lengths = np.diff(starts)
        self.edits = np.minimum((self.lengths * EDIT_SHARE).astype(np.int64), np.maximum((self.lengths + 1) // Q - 1, 0))
        # q-gram lemma: of the m + 1 - q grams, each edit spoils q at most.
        self.needed = np.maximum(self.lengths + 1 - Q - Q * self.edits, 1)
        hashes, item, place = [], [], []
        for k, own in enumerate(self.codes):
            h = grams(own)
            hashes.append(h)
            item.append(np.full(len(h), k, np.int64))
            place.append(np.arange(len(h)))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.distinct, first = np.unique(self.hashes, return_index=True)
        self.first = np.append(first, len(self.hashes))
        self.present = np.zeros(1 << _TABLE_BITS, bool)
        self.present[self.distinct >> U64(64 - _TABLE_BITS)] = True

    def regions(self, flat: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, begin, end) of diagonal bands with enough shared q-grams."""
        h = grams(flat)
        at = np.flatnonzero(self.present[h >> U64(64 - _TABLE_BITS)])
        if not len(at) or not len(self.distinct):
            return []
        slot = np.searchsorted(self.distinct, h[at])
        slot[slot == len(self.distinct)] = 0
        same = self.distinct[slot] == h[at]
        at, slot = at[same], slot[same]
        text = np.searchsorted(starts, at, "right") - 1
        inside = at + Q <= starts[text + 1]
        at, slot, text = at[inside], slot[inside], text[inside]
        many = self.first[slot + 1] - self.first[slot]
        if not many.sum():
            return []
        where = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        at, text = np.repeat(at, many), np.repeat(text, many)
        item = self.item[where]
        diagonal = at - self.place[where]
        # Bands of 2 (k + 1) diagonals that begin every k + 1: any k + 1 diagonals lie in one.
        step = self.edits[item] + 1
        band = diagonal // step
        own = np.concatenate([band, band - 1])
        text, item, step = np.tile(text, 2), np.tile(item, 2), np.tile(step, 2)
        order = np.lexsort((own, item, text))
        text, item, step, own = text[order], item[order], step[order], own[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (own[1:] != own[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(text)))
        # A gram that repeats in a band counts each time: the lemma needs a lower bound only.
        good = begin[size >= self.needed[item[begin]]]
        low = own[good] * step[good]
        return list(zip(*(x.tolist() for x in (text[good], item[good], low, low + 2 * step[good])), strict=True))


def banded_edits(pattern: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int]:
    """(edits, begin, end) of the best match of ``pattern`` on the diagonals first..last, widened by ``most``.

    ``edits`` is most + 1 if there is none within ``most``.  Rows of the table
    are numpy arrays over the band; the match may begin and end anywhere.
    """
    low, high = first - most, last + most
    width, worst = high - low + 1, most + 1
    column = np.arange(width)
    ends = low + column  # place in the text after row 0
    row = np.where((ends >= 0) & (ends <= len(text)), 0, worst)
    origin = ends.copy()
    padded = np.full(width, 0xFFFFFFFF, np.uint32)
    for r, letter in enumerate(pattern):
        at = low + r + column
        usable = (at >= 0) & (at < len(text))
        padded[:] = 0xFFFFFFFF
        padded[usable] = text[at[usable]]
        step = row + (padded != letter)
        source = origin.copy()
        above = np.append(row[1:], worst) + 1
        better = above < step
        step[better], source[better] = above[better], np.append(origin[1:], 0)[better]
        # Insertions run along the row: a running minimum of cost minus column.
        lead = step - column
        run = np.minimum.accumulate(lead)
        best = np.maximum.accumulate(np.where(lead == run, column, 0))
        row = np.minimum(run + column, worst)
        origin = source[best]
        if row.min() > most:
            return worst, 0, 0
    places = low + len(pattern) + column
    row = np.where((places >= 0) & (places <= len(text)), row, worst)
    k = int(row.argmin())
    return int(row[k]), int(origin[k]), int(places[k])


def _matches(passages: Passages, texts: list[str]) -> Iterator[tuple[int, dict]]:
    """(first text, {(text, item): (edits, begin, end)}) of consecutive texts, the best match of each."""
    begin = 0
    while begin < len(texts):
        end, total = begin, 0
        while end < len(texts) and (end == begin or total + len(texts[end]) <= CHUNK_CHARS):
            total += len(texts[end])
            end += 1
        flat, starts = normalised(*code_points(texts[begin:end]))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, low, high in passages.regions(flat, starts):
            known = best.get((text, item))
            if known and known[0] == 0:
                continue
            own = flat[starts[text]: starts[text + 1]]
            pattern, most = passages.codes[item], int(passages.edits[item])
            low, high = low - int(starts[text]), high - int(starts[text])
            found = _exact(pattern, own, low, high) or banded_edits(pattern, own, low, high, most)
            if found[0] <= most and (known is None or found[0] < known[0]):
                best[text, item] = found
        yield begin, best
        begin = end


def _scan(docs: DataFrame, passages: Passages) -> DataFrame:
    def run(batch):
        ids = batch.column("doc_id").to_pylist()
        for begin, best in _matches(passages, batch.column("text").to_pylist()):
            rows = [(ids[begin + t], int(passages.ids[i]), e, a, b, len(passages.codes[i])) for (t, i), (e, a, b) in best.items()]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield {n: pa.array(c, k) for n, c, k in zip(
                    ("doc_id", "item_id", "edits", "begin", "end", "item_chars"), zip(*rows, strict=True), kinds, strict=True)}

    return arrow(run, docs, "doc_id long, item_id long, edits int, begin long, end long, item_chars long")


def _exact(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """A verbatim match on the band's diagonals, without alignment."""
    part = text[max(0, low): high + len(pattern)].tobytes()
    at = part.find(pattern.tobytes())
    while at >= 0 and at % 4:
        at = part.find(pattern.tobytes(), at + 1)
    return None if at < 0 else (0, max(0, low) + at // 4, max(0, low) + at // 4 + len(pattern))


def passage_blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Passages in blocks of a bounded number of characters, one pass over the documents each."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text_or_empty()).distinct()
    blocks, size = [[]], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if size and size + len(row["text"]) > BLOCK_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append((row["item_id"], row["text"]))
        size += len(row["text"])
    return [b for b in blocks if b]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, begin, end, item_chars): passages found in documents.

    Both sides are lower-cased letters and digits with single blanks.  A
    passage is found if some part of a document is within ``edits`` <= 7
    percent of its length; the row has the best such part, in places of the
    normalised text.  Passages shorter than 10 normalised characters hold no
    q-gram and are not searched.

    Null texts and passages are empty and never match; null item ids are
    skipped; null doc ids are searched and carried; repeated documents give
    repeated rows, repeated passages one; empty tables give no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    found = None
    for block in passage_blocks(benchmark):
        part = _scan(rows, Passages([i for i, _ in block], [t for _, t in block]))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, edits int, begin long, end long, item_chars long")
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no passage is found, all columns as they are.

    Rows are judged one by one, as in ``leaks``; nothing is shuffled.
    """
    for block in passage_blocks(benchmark):
        passages = Passages([i for i, _ in block], [t for _, t in block])

        def run(batches, passages=passages):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for begin, best in _matches(passages, [t or "" for t in batch.column("text").to_pylist()]):
                    keep[[begin + t for t, _ in best]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
