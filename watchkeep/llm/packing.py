"""Best-fit packing of token sequences, certified by lower bounds and repacked."""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from watchkeep.llm.common import U64, Words, arrow, store, text_chunks, text_or_empty

# Chunks that a worker remembers, about 90 MB.
REMEMBERED = 2_000_000
# Pieces that one partition packs.
PART_ROWS = 100_000


class Known:
    """Token ids of chunks by their 64-bit hashes: an open-addressed table of arrays.

    When it holds ``most`` chunks, further ones are not remembered.
    """

    def __init__(self, most: int):
        self.most, self.count, self.used = most, 0, 0
        self.bits = (2 * most - 1).bit_length()
        self.places = np.full(1 << self.bits, -1, np.int32)
        self.hashes = np.empty(most, U64)
        self.begins, self.sizes = np.empty(most, np.int64), np.empty(most, np.int64)
        self.pool = np.empty(1 << 16, np.uint32)

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of every hash, -1 if there is none."""
        at = self._at(hashes)
        found = self.places[at]
        open_rows = np.flatnonzero((found >= 0) & (self.hashes[found] != hashes))
        while len(open_rows):
            at[open_rows] = (at[open_rows] + 1) & (len(self.places) - 1)
            entry = self.places[at[open_rows]]
            found[open_rows] = entry
            open_rows = open_rows[(entry >= 0) & (self.hashes[entry] != hashes[open_rows])]
        return found

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Remember distinct new ``hashes``; ``ids`` holds ``sizes`` ids of each in a row."""
        room = min(len(hashes), self.most - self.count)
        hashes, sizes = hashes[:room], sizes[:room]
        ids = ids[: int(sizes.sum())]
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used: self.used + len(ids)] = ids
        entries = np.arange(self.count, self.count + room)
        self.hashes[entries], self.sizes[entries] = hashes, sizes
        self.begins[entries] = self.used + np.cumsum(sizes) - sizes
        self.count, self.used = self.count + room, self.used + len(ids)
        at = self._at(hashes)
        while len(entries):
            free = self.places[at] < 0
            self.places[at[free]] = entries[free]
            left = self.places[at] != entries  # of those that met in one place, one stays
            entries, at = entries[left], (at[left] + 1) & (len(self.places) - 1)


def fits(stated: dict) -> bool:
    """Whether a tokenizer file encodes chunks between white space apart, and letters in any case alike."""
    steps = lambda part, names: (part or {}).get(names) or [part or {}]
    lowers = any(n.get("type") == "Lowercase" for n in steps(stated["normalizer"], "normalizers"))
    cuts = any(
        p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and "[^\\s" in p["pattern"].get("Regex", "")
        for p in steps(stated["pre_tokenizer"], "pretokenizers"))
    whole = stated["model"].get("end_of_word_suffix") == "</w>" and not stated["truncation"] and not stated["padding"]
    return lowers and cuts and whole and all(t["content"].startswith("<|") for t in stated["added_tokens"])


class Encoder:
    """Ids of texts by a tokenizer whose pre-tokens never hold white space.

    A text is cut at white space; every chunk's ids are remembered by its hash,
    so a text's ids are those of its chunks in a row.  Chunks of letters are
    encoded together, and told apart by the mark at the end of every word.
    Texts that may hold special tokens are encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        if not fits(stated):
            raise ValueError("packing needs a lower-casing BPE of words without white space, and added tokens that begin with <|")
        self.tokenizer = Tokenizer.from_file(path)
        ends = [n for t, n in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True
        self.known = Known(REMEMBERED)

    def _encode(self, chunks: list[str]) -> dict[str, bytes]:
        words, rest = [], []
        for chunk in chunks:
            (words if chunk.isalpha() and chunk.lower().isalpha() else rest).append(chunk)
        done: dict[str, bytes] = {}
        groups = [words[i: i + 200] for i in range(0, len(words), 200)]
        joined = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, answer in zip(groups, joined, strict=True):
            ids = np.array(answer.ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(group):
                rest += group
                continue
            content, begin = ids.tobytes(), 0
            for word, end in zip(group, (last * 4).tolist(), strict=True):
                done[word] = content[begin:end]
                begin = end
        for chunk, answer in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            done[chunk] = np.array(answer.ids, "<u4").tobytes()
        return done

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; a comma or full stop after letters is a token of its own."""
        cut = [c[-1] in ",." and c[:-1].isalpha() for c in chunks]
        cores = [c[:-1] if short else c for c, short in zip(chunks, cut, strict=True)]
        done = self._encode(list(dict.fromkeys([*cores, ",", "."])))
        return [done[core] + done[c[-1]] if short else done[core] for c, core, short in zip(chunks, cores, cut, strict=True)]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of consecutive UTF-8 texts as little-endian unsigned 32-bit numbers."""
        words, known = Words(data, offsets), self.known
        entry = known.find(words.hashes)
        missing = np.flatnonzero(entry < 0)
        fresh, first, which = np.unique(words.hashes[missing], return_index=True, return_inverse=True)
        begins, ends, content = words.starts[missing[first]].tolist(), words.ends[missing[first]].tolist(), data.tobytes()
        answers = self._ids_of([content[x:y].decode() for x, y in zip(begins, ends, strict=True)])
        fresh_sizes = np.array([len(x) // 4 for x in answers], np.int64)
        fresh_ids = np.frombuffer(b"".join(answers), "<u4")

        begin, size = known.begins[entry], known.sizes[entry]
        begin[missing] = (np.cumsum(fresh_sizes) - fresh_sizes)[which] + known.used
        size[missing] = fresh_sizes[which]
        pool = np.concatenate([known.pool[: known.used], fresh_ids])
        known.add(fresh, fresh_sizes, fresh_ids)

        places = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat(begin - places[:-1], size) + np.arange(places[-1])].astype("<u4")
        bounds = places[words.first].tolist()
        out = [ids[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        for row in np.unique(np.searchsorted(offsets, marks, "right") - 1).tolist():
            whole = content[offsets[row]: offsets[row + 1]].decode()
            out[row] = np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and a closing id 0."""
    def run(batch):
        numbers, work = batch.column("doc_id").to_pylist(), encoder(path)
        for begin, end, data, offsets in text_chunks(batch):
            out = []
            for number, content in zip(numbers[begin:end], work.ids(data, offsets), strict=True):
                content += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(content), 4 * capacity)):
                    part = content[at: at + 4 * capacity]
                    out.append((number, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield {n: pa.array(c, k) for n, c, k in zip(("doc_id", "piece", "start", "length", "ids_crc32"), columns, kinds, strict=True)}

    return arrow(run, docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()),
                 "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that ``counts[length]`` pieces need at least, by dual feasible functions.

    A function that maps lengths to shares, so that what fits in one sequence
    never sums to more than 1, bounds the number of sequences by the sum of the
    shares.  Used: the length itself; lengths over capacity - e as whole and
    those below e as nothing; and, rounded down, multiples of capacity / (k + 1).
    """
    lengths = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * lengths).sum()) // capacity)
    total = np.concatenate([[0], np.cumsum(counts * lengths)])
    many = np.concatenate([[0], np.cumsum(counts)])
    for e in range(1, capacity // 2 + 1):
        large = int(many[-1] - many[capacity - e + 1])
        middle = int(total[capacity - e + 1] - total[e])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 21):
        scaled = lengths * (k + 1)
        share = np.where(scaled % capacity == 0, lengths * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * share).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of its bin) of every piece; the longest first, each where least room stays."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r tokens of room
    fills: list[int] = []
    for row in order.tolist():
        length = int(lengths[row])
        fitting = open_rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            number, room = len(fills), capacity
            fills.append(0)
        where[row], offset[row] = number, fills[number]
        fills[number] += length
        left = room - length
        if left:
            if not rooms[left]:
                open_rooms |= 1 << left
            rooms[left].append(number)
    return where, offset, np.array(fills, np.int64)[where] if len(fills) else where


def _pack(rows: DataFrame, parts: int, capacity: int, step: int) -> DataFrame:
    """Pack ``rows`` (row, length) in ``parts`` groups; sequence ids are unique over steps.

    ``gap``: the group has more sequences than its lower bound.
    """
    def group(key, frame):
        lengths = frame["length"].to_numpy()
        where, offset, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        gap = int(where.max()) + 1 > bound
        return pd.DataFrame({
            "row": frame["row"], "length": lengths, "sequence_id": (step << 56) + (int(key[0]) << 24) + where,
            "offset": offset, "fill": fill, "gap": gap})

    # Rows, not documents or sources, are dealt by a hash of a unique number: no group is hot.
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(step)), F.lit(parts)))
    return store(dealt.groupBy("part").applyInPandas(
        group, "row long, length long, sequence_id long, offset long, fill long, gap boolean"), "packed")


def pack(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens.

    Partitions of about 100,000 pieces are packed by best-fit decreasing.  Dual
    feasible functions bound each partition's sequences from below; partitions
    that reach the bound, and full sequences, are final.  The pieces of the
    sequences with room in partitions with a gap are dealt anew over fewer
    partitions, of about 100,000 pieces at most, and packed again, until the
    whole reaches its own bound or a round saves no sequence at that size; such
    a round is dropped.

    Null and empty texts are the closing id alone; only documents longer than
    ``capacity`` are cut; repeated rows are packed each; an empty table gives no
    rows; other columns are not read.
    """
    found = store(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    by_length = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_length.items():
        counts[length] = n
    bound, parts, step = lower_bound(counts, capacity), max(1, -(-int(counts.sum()) // PART_ROWS)), 0
    final, open_rows = [], found.select("row", "length")
    placed_sequences, before, bounded = 0, None, parts == 1
    while True:
        packed = _pack(open_rows, parts, capacity, step)
        again = F.col("gap") & (F.col("fill") < capacity)
        sequences = packed.where("offset = 0").agg(
            F.count("*").alias("n"), F.count(F.when(again, 1)).alias("open"),
            F.sum(F.when(again, F.col("fill"))).alias("tokens")).first()
        if before is not None and sequences["n"] >= before[1]:
            # Nothing is saved: the places before this round stay.
            packed, sequences = before[0], {"n": before[1], "open": before[1], "tokens": before[2]}
            again = F.lit(True)
            if bounded:
                final.append(packed)
                break
        left = -(-(sequences["tokens"] or 0) // capacity)
        certified = placed_sequences + sequences["n"] <= bound
        # Dealt over fewer partitions, open sequences can only be saved down to their tokens.  Ids have room for 127 steps.
        if certified or parts == 1 or sequences["open"] <= left or step == 127:
            final.append(packed)
            break
        final.append(packed.where(~again))
        placed_sequences += sequences["n"] - sequences["open"]
        before = packed.where(again), sequences["open"], sequences["tokens"]
        open_rows = before[0].select("row", "length")
        least = max(1, -(-open_rows.count() // PART_ROWS))
        parts, step = max(parts // 4, least), step + 1
        bounded = parts == least
    chosen = final[0]
    for more in final[1:]:
        chosen = chosen.unionByName(more)
    return found.join(chosen.select("row", "sequence_id", "offset"), "row").drop("row")
