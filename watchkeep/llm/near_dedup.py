"""Near duplicates: b-bit MinHash signatures joined by a multi-index on Hamming distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from watchkeep.llm.common import BASE, GOLDEN, MIX_A, MIX_B, U64, Words, arrow, mix, store, text_chunks, text_or_empty
from watchkeep.llm.components import components

# A signature has POSITIONS values of 8 bits, in CHUNKS chunks.  Two signatures
# that differ in at most CHUNKS * (ERRORS + 1) - 1 = 23 positions agree, in some
# chunk, in all but ERRORS positions at most: one key per chunk and choice of
# left-out position finds them all.
POSITIONS, CHUNKS, ERRORS = 72, 12, 1
WIDTH = POSITIONS // CHUNKS
LONGS = POSITIONS // 8
# At a similarity of 0.8, 14.3 of 72 positions differ on average (deviation
# 3.4).  A pair is missed by the keys with probability 3e-6, and by this
# distance with probability 3e-7.
MOST_DISTANCE = 32
PERCENT = 80
# Shingles in a block of sets that are compared in one go.
BLOCK_SHINGLES = 65_536
_ROWS = 2048
_XOR = mix((np.arange(POSITIONS, dtype=U64) + U64(1)) * GOLDEN)
_ODD = mix((np.arange(POSITIONS, dtype=U64) + U64(101)) * GOLDEN) | U64(1)


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """The distinct shingles of one text, sorted; a shorter text is one shingle."""
    if len(hashes) < words:
        window = hashes[:1].copy()
        for h in hashes[1:]:
            window = mix(window * BASE + h)
        return window
    window = hashes[: len(hashes) - words + 1].copy()
    for k in range(1, words):
        window = mix(window * BASE + hashes[k: len(hashes) - words + 1 + k])
    return np.unique(window)


def signature(found: np.ndarray) -> np.ndarray:
    """The low 8 bits of the least hash under each of POSITIONS hash functions."""
    least = np.full(POSITIONS, ~U64(0))
    for begin in range(0, len(found), _ROWS):
        part = (found[begin: begin + _ROWS, None] ^ _XOR) * _ODD
        np.minimum(least, (part ^ (part >> U64(29))).min(axis=0), out=least)
    return (mix(least) & U64(255)).astype(np.uint8)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, x, y, signature) of every row; (n, x, y) stands for the set."""
    def run(batch):
        ids = batch.column("doc_id")
        for begin, end, data, offsets in text_chunks(batch):
            w = Words(data, offsets)
            count = end - begin
            sizes, x, y = np.zeros(count, np.int64), np.zeros(count, U64), np.zeros(count, U64)
            signs = np.zeros((count, POSITIONS), np.uint8)
            for k in range(count):
                found = shingles(w.hashes[w.first[k]: w.first[k + 1]], words)
                sizes[k] = len(found)
                if len(found):
                    x[k], y[k] = found.sum(dtype=U64), mix(found ^ MIX_A).sum(dtype=U64)
                    signs[k] = signature(found)
            yield {"doc_id": ids.slice(begin, count), "n_shingles": sizes, "x": x, "y": y,
                   **{f"s{i}": signs.view(np.int64)[:, i].copy() for i in range(LONGS)}}

    columns = ", ".join(f"s{i} long" for i in range(LONGS))
    return arrow(run, docs.select("doc_id", text_or_empty()), f"doc_id long, n_shingles long, x long, y long, {columns}")


def index_keys(signed: DataFrame) -> DataFrame:
    """(key, id): a key per chunk and left-out position of every signature."""
    def run(batch):
        signs = np.stack([batch.column(f"s{i}").to_numpy() for i in range(LONGS)], axis=1)
        parts = np.ascontiguousarray(signs).view(np.uint8).reshape(-1, CHUNKS, WIDTH).astype(U64) + U64(1)
        weights = mix((np.arange(CHUNKS * WIDTH, dtype=U64) + U64(7)) * MIX_B).reshape(CHUNKS, WIDTH) | U64(1)
        # A sum with the left-out position's share taken away, and the position mixed in.
        shares = mix(parts * weights)
        keys = mix(shares.sum(axis=2, keepdims=True, dtype=U64) - shares + weights)
        ids = np.repeat(batch.column("id").to_numpy(), CHUNKS * WIDTH)
        yield {"key": keys.reshape(-1), "id": ids}

    return arrow(run, signed.select("id", *[f"s{i}" for i in range(LONGS)]), "key long, id long")


def distance(left: str, right: str) -> Column:
    """Positions in which two signatures differ: bytes of the exclusive or that are not zero."""
    total = F.lit(0)
    for i in range(LONGS):
        z = F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))
        for shift in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        total = total + F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def confirmed(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets are similar enough."""
    def run(batch):
        if not batch.num_rows:
            return
        keep = np.zeros(batch.num_rows, bool)
        sets = []
        for column in ("ta", "tb"):
            own = []
            for begin, end, data, offsets in text_chunks(batch, column):
                w = Words(data, offsets)
                own += [shingles(w.hashes[w.first[k]: w.first[k + 1]], words) for k in range(end - begin)]
            sets.append(own)
        for k, (one, two) in enumerate(zip(*sets, strict=True)):
            shared = len(np.intersect1d(one, two, assume_unique=True))
            keep[k] = shared > 0 and 100 * shared >= PERCENT * (len(one) + len(two) - shared)
        yield {n: batch.column(n).filter(pa.array(keep)) for n in ("a", "b")}

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = store(texts.join(wanted, "id", "left_semi"), "texts")
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(
        held.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return store(arrow(run, both.select("a", "b", "ta", "tb"), "a long, b long"), "confirmed")


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batch):
        ids = batch.column("id")
        for begin, end, data, offsets in text_chunks(batch):
            w = Words(data, offsets)
            sets = [shingles(w.hashes[w.first[k]: w.first[k + 1]], words) for k in range(end - begin)]
            places = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield {"id": ids.slice(begin, end - begin),
                   "shingles": pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(sets).view(np.int64)))}

    return arrow(run, texts.select("id", "text"), "id long, shingles array<long>")


def _inside_mixed(buckets: DataFrame, roots: DataFrame, signed: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Links (a, b) between components inside the buckets that hold several.

    In such a bucket the ids outside its hub's component are compared with all
    ids of the bucket, on full sets.  Rows are blocks of bounded size, in pairs
    per hub: a large group is dealt over many tasks, pairs inside a component
    are skipped, and only links are given out.
    """
    labelled = buckets.join(roots, "id").join(roots.select(F.col("id").alias("hub"), F.col("root").alias("hub_root")), "hub")
    labelled = store(labelled.select("key", "hub", "id", "root", (F.col("root") != F.col("hub_root")).alias("guest")), "labelled")
    mixed = store(labelled.where("guest").select("key").distinct(), "mixed-keys")
    rows = labelled.join(mixed, "key", "left_semi").groupBy("hub", "id", "root").agg(F.max("guest").alias("guest"))
    rows = store(rows.join(signed.select("id", "n_shingles"), "id"), "mixed")
    sets = store(_shingle_sets(texts.join(rows.select("id").distinct(), "id", "left_semi"), words), "sets")
    count = lambda c: F.ceil(F.sum(c) / BLOCK_SHINGLES).cast("int")
    # Stored, so that the join with it can be split where a hub has very many rows.
    sizes = store(rows.groupBy("hub").agg(
        count("n_shingles").alias("blocks"), count(F.when(F.col("guest"), F.col("n_shingles"))).alias("guest_blocks")), "hub-sizes")
    dealt = store(rows.join(sizes, "hub").join(sets, "id").select(
        "hub", "id", "root", "guest", "shingles", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"),
        F.pmod(F.xxhash64("id"), "guest_blocks").cast("int").alias("guest_block")), "dealt")
    packed = F.collect_list(F.struct("id", "root", "shingles"))
    whole = dealt.groupBy("hub", "block").agg(packed.alias("whole"))
    guests = dealt.where("guest").groupBy("hub", "guest_block").agg(packed.alias("guests"))
    pairs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1)).alias("guest_block"), "blocks").select(
        "hub", "guest_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(batch):
        for one, two in zip(batch.column("guests"), batch.column("whole"), strict=True):
            found = _links_between(*_unpacked(one), *_unpacked(two))
            if len(found):
                yield {"a": found[:, 0].copy(), "b": found[:, 1].copy()}

    both = pairs.join(guests, ["hub", "guest_block"]).join(whole, ["hub", "block"]).select("guests", "whole")
    return store(arrow(run, both, "a long, b long"), "confirmed")


def _unpacked(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, roots, offsets, shingles) of a block."""
    rows = block.values
    lists = rows.field("shingles")
    offsets = lists.offsets.to_numpy()
    return rows.field("id").to_numpy(), rows.field("root").to_numpy(), offsets - offsets[0], lists.flatten().to_numpy()


def _links_between(ids, roots, places, found, other_ids, other_roots, other_places, other) -> np.ndarray:
    """(id, other id) of similar enough sets with different roots.

    Each set marks its shingles among the other block's distinct ones; sums of
    marks are the numbers of shared shingles with every set there.
    """
    distinct, number = np.unique(other, return_inverse=True)
    sizes, out = np.diff(other_places), []
    for k in range(len(ids)):
        own = found[places[k]: places[k + 1]]
        at = np.searchsorted(distinct, own)
        at[at == len(distinct)] = 0
        marks = np.zeros(len(distinct), np.int32)
        marks[at[distinct[at] == own]] = 1
        shared = np.add.reduceat(marks[number], other_places[:-1])
        near = (100 * shared >= PERCENT * (len(own) + sizes - shared)) & (other_roots != roots[k])
        out.append(np.stack([np.full(int(near.sum()), ids[k]), other_ids[near]], axis=1))
    return np.concatenate(out)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) after links between ids of different components."""
    at = lambda side: roots.select(F.col("id").alias(side), F.col("root").alias(f"r{side}"))
    between = links.join(at("a"), "a").join(at("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    up = components(between).select(F.col("v").alias("root"), F.col("root").alias("top"))
    return store(roots.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "components")


def _roots(links: DataFrame, ids: DataFrame) -> DataFrame:
    return store(ids.join(components(links).withColumnRenamed("v", "id"), "id", "left").select(
        "id", F.coalesce("root", "id").alias("root")), "components")


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Texts with equal shingle sets are one: the row with the smallest doc_id
    stands for them.  Signatures of these get index keys: pairs that differ in 23
    positions or fewer are sure to meet, pairs in 24 to MOST_DISTANCE meet by
    chance and are then accepted like the others.  In each bucket of a
    key all are compared with the smallest id; most groups are settled by that.
    In buckets with several components, ids outside the smallest id's component
    are compared with all others, in blocks; pairs inside a component are not
    enumerated.  Every link is confirmed on full sets.

    Null and empty texts have no shingles and no links; fewer words than a
    shingle make one shingle; repeated rows get equal results; rows with a null
    doc_id take no part, have a null component and are kept; an empty table
    gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = [f"s{i}" for i in range(LONGS)]
    found = store(sketch(docs, words), "sketch")
    sets = found.where("n_shingles > 0 and doc_id is not null")
    standing = store(sets.groupBy("n_shingles", "x", "y").agg(F.min("doc_id").alias("id")), "sets")
    signed = store(sets.join(standing, ["n_shingles", "x", "y"]).where("doc_id = id").select("id", "n_shingles", *signs).distinct(), "signed")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(signed.select("id"), "id", "left_semi")

    # Buckets with two ids at least, and the smallest of each.
    keys = index_keys(signed)
    shared = store(keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("key", "hub"), "shared-keys")
    buckets = store(keys.join(shared, "key").select("key", "id", "hub").distinct(), "buckets")

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that the sizes of their sets and their signatures allow."""
        one = pairs.join(signed.select(F.col("id").alias("a"), F.struct("n_shingles", *signs).alias("p")), "a")
        two = one.join(signed.select(F.col("id").alias("b"), F.struct("n_shingles", *signs).alias("q")), "b")
        return two.where(_sizes("p", "q") & (distance("p", "q") <= MOST_DISTANCE)).select("a", "b")

    tested = store(near(buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()), "pairs")
    links = confirmed(tested, texts, words)
    roots = _roots(links, signed.select("id"))

    links = _inside_mixed(buckets, roots, signed, texts, words)
    roots = _merged(roots, links)

    member = found.join(standing, ["n_shingles", "x", "y"], "left").join(roots, "id", "left")
    component = F.coalesce("root", "doc_id")
    return member.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns as they are.

    Rows that share a doc_id are one document: they stay or go together.
    """
    dropped = near_duplicates(docs, words).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def _sizes(left: str, right: str) -> Column:
    """The smaller set has PERCENT of the larger one's size at least."""
    m, n = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    return (100 * m >= PERCENT * n) & (100 * n >= PERCENT * m)
