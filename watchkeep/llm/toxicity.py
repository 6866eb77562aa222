"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from watchkeep.llm.common import U64, arrow, held_out, mix, powers, store, text_or_empty
from watchkeep.llm.decontamination import CHUNK_CHARS, code_points, normalised
from watchkeep.llm.labelled import Adam, labelled_sample, sigmoid

SIZES = (4, 5, 6)
BUCKETS = 1 << 20
# Bound of the labelled sample, in documents, and of the features kept.
SAMPLE_ROWS, FEATURES, LEAST_DOCS = 12_000, 16_384, 5


def _chunks(ids: list, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, text number, bucket) of the distinct n-grams of consecutive texts."""
    begin = 0
    while begin < len(ids):
        end, total = begin, 0
        while end < len(ids) and (end == begin or total + len(texts[end]) <= CHUNK_CHARS):
            total += len(texts[end])
            end += 1
        # A blank on both sides of a text, so that its first and last words have their edges.
        codes, starts = normalised(*code_points(texts[begin:end]))
        owner = np.repeat(np.arange(end - begin), np.diff(starts) + 2)
        padded = np.full(len(owner), 32, np.uint32)
        padded[np.arange(len(codes)) + 1 + 2 * np.repeat(np.arange(end - begin), np.diff(starts))] = codes
        yield begin, end, owner, padded
        begin = end


def _grams(owner: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of ``size`` characters inside one text."""
    if len(codes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * up[: len(codes)], out=total[1:])
    h = mix((total[size:] - total[:-size]) * down[: len(codes) - size + 1] + U64(size))
    bucket = (h & U64(BUCKETS - 1)).astype(np.int64)
    inside = owner[: len(bucket)] == owner[size - 1:]
    return owner[: len(bucket)][inside], bucket[inside]


def distinct_buckets(owner: np.ndarray, codes: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """text * BUCKETS + bucket of each text's n-grams, once each; only ``wanted`` buckets."""
    out = []
    for size in SIZES:
        text, bucket = _grams(owner, codes, size)
        if wanted is not None:
            keep = wanted[bucket]
            text, bucket = text[keep], bucket[keep]
        out.append(text * BUCKETS + bucket)
    return np.unique(np.concatenate(out))


def document_frequencies(sample: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): documents of each label that hold the bucket; BUCKETS rows at most."""
    def run(batch):
        ids, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
        labels = batch.column("label").to_numpy()
        counts = np.zeros((2, BUCKETS), np.int32)
        for begin, _, owner, codes in _chunks(ids, texts):
            found = distinct_buckets(owner, codes)
            label = labels[begin + found // BUCKETS]
            for value in (0, 1):
                counts[value] += np.bincount(found[label == value] % BUCKETS, minlength=BUCKETS).astype(np.int32)
        used = np.flatnonzero(counts.sum(axis=0))
        yield {"bucket": used.astype(np.int32), "toxic": counts[1, used], "clean": counts[0, used]}

    rows = arrow(run, sample.select("key", "text", "label"), "bucket int, toxic int, clean int")
    return rows.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(sample: DataFrame, features: int = FEATURES) -> np.ndarray:
    """Weights per bucket, the last entry the bias; sums over present buckets are log odds.

    A feature's value is its log-count ratio r = log((p + 1) / |p|) - log((n + 1) / |n|)
    if present.  Kept are the ``features`` with the largest |r| times documents
    of their rarer side's support; the linear weights are fitted with a small
    quadratic penalty, both classes with equal weight.
    """
    sample = store(sample.repartition("key"), "labelled")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(BUCKETS + 1, np.float32)
    if len(sizes) < 2:
        weights[-1] = 4.0 if 1 in sizes else -4.0
        return weights
    toxic, clean = F.col("toxic") + 1.0, F.col("clean") + 1.0
    ratio = F.log(toxic / (sizes[1] + 2.0)) - F.log(clean / (sizes[0] + 2.0))
    seen = document_frequencies(sample).where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).select(
        "bucket", ratio.alias("r"), (F.abs(ratio) * F.sqrt(F.col("toxic") / sizes[1] + F.col("clean") / sizes[0])).alias("use"))
    best = seen.orderBy(F.desc("use"), "bucket").limit(features).toPandas().sort_values("bucket")
    if not len(best):
        weights[-1] = np.log(sizes[1] / sizes[0])
        return weights
    wanted = np.zeros(BUCKETS, bool)
    wanted[best["bucket"]] = True
    ratios = best["r"].to_numpy()

    def run(batch):
        ids, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
        for begin, end, owner, codes in _chunks(ids, texts):
            found = distinct_buckets(owner, codes, wanted)
            size = np.bincount(found // BUCKETS, minlength=end - begin)
            places = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(places, pa.array((found % BUCKETS).astype(np.int32)))
            yield {"label": batch.column("label").slice(begin, end - begin), "buckets": lists}

    table = arrow(run, sample.select("key", "text", "label"), "label int, buckets array<int>").toArrow()
    label = table.column("label").to_numpy().astype(np.float64)
    lists = table.column("buckets").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    index = np.searchsorted(best["bucket"].to_numpy(), lists.flatten().to_numpy())
    owner = np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy()))
    values = ratios[index]
    balance = np.where(label == 1, 0.5 / sizes[1], 0.5 / sizes[0])
    p = {"w": np.full(len(best), 0.1), "b": np.zeros(1)}
    adam = Adam(p, 0.02)
    for _ in range(200):
        odds = np.bincount(owner, values * p["w"][index], minlength=len(label)) + p["b"]
        error = (sigmoid(odds) - label) * balance
        slope = np.bincount(index, values * error[owner], minlength=len(best))
        adam.update({"w": slope + 2e-5 * p["w"], "b": np.array([error.sum()])})
    weights[best["bucket"]] = p["w"] * ratios
    weights[-1] = p["b"][0]
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every whole text; the weights are one array of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch):
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        held = shared.value
        wanted = held[:-1] != 0
        for begin, end, owner, codes in _chunks(texts, texts):
            found = distinct_buckets(owner, codes, wanted)
            odds = np.bincount(found // BUCKETS, held[found % BUCKETS], minlength=end - begin) + float(held[-1])
            yield {"doc_id": ids.slice(begin, end - begin), "score": sigmoid(odds)}

    return arrow(run, docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, unseen: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Learns from at most ``sample_rows`` labelled documents, none of them
    ``unseen`` (crc32 of the id modulo 3 is 1).  Null and empty texts get the
    bias alone; repeated rows equal scores; null ids are not held out; with one
    label or none all scores lie on its side; an empty table gives no rows;
    other columns are not read.
    """
    unseen = held_out(F.col("doc_id"), 3, 1) if unseen is None else unseen
    weights = fit(labelled_sample(docs, labels, "toxic", unseen, sample_rows))
    return score(docs, weights).select(
        "doc_id", unseen.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
