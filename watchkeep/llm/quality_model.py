"""Document quality by multiple-instance learning with gated attention over passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from watchkeep.llm.common import Words, arrow, held_out, text_chunks, text_or_empty
from watchkeep.llm.labelled import Adam, labelled_sample, sigmoid

PASSAGE_WORDS = 64
# Bound of the labelled sample, in documents.
SAMPLE_ROWS = 4_000
HIDDEN, GATES, STEPS = 16, 8, 200


def _class(characters: str) -> np.ndarray:
    table = np.zeros(256, np.float32)
    table[list(characters.encode())] = 1
    return table


_BYTE_CLASSES = np.stack([
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789"),
    _class("#*$%&<>|@~^_=+"), _class("|"), _class("!?"), _class(".,;:"), _class("'\"()[]{}-/\\"), _class("\n"),
    np.array([b >= 128 for b in range(256)], np.float32),
])
FEATURES = len(_BYTE_CLASSES) + 7


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, passages per text): PASSAGE_WORDS words a passage; a text without words has one of zeros."""
    w = Words(data, offsets)
    words = np.diff(w.first)
    count = np.maximum(1, -(-words // PASSAGE_WORDS))
    owner = np.repeat(np.arange(len(words)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = w.first[owner] + within * PASSAGE_WORDS
    end = np.minimum(begin + PASSAGE_WORDS, w.first[owner + 1])
    size = end - begin
    out = np.zeros((len(owner), FEATURES), np.float32)
    full = size > 0
    if not full.any():
        return out, count
    begin, end, size = begin[full], end[full], size[full].astype(np.float32)
    low, high = w.starts[begin], w.ends[end - 1]
    span = (high - low).astype(np.float32)

    def sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.float64)
        np.cumsum(values, out=total[1:])
        return (total[b] - total[a]).astype(np.float32)

    columns = [sums(table[data], low, high) / span for table in _BYTE_CLASSES]
    lengths = (w.ends - w.starts).astype(np.float32)
    same = np.zeros(len(w.hashes), np.float32)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    # Distinct words of a passage: the first of equal (passage, hash) pairs.
    place = np.repeat(np.arange(len(begin)), (end - begin))
    used = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange(int(size.sum()))
    order = np.lexsort((w.hashes[used], place))
    h, p = w.hashes[used][order], place[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    distinct = np.bincount(p[fresh], minlength=len(begin)).astype(np.float32)
    mean = sums(lengths, begin, end) / size
    columns += [
        mean / 10, np.sqrt(np.maximum(sums(lengths * lengths, begin, end) / size - mean * mean, 0)) / 10,
        distinct / size, sums(same, begin, end) / size, size / PASSAGE_WORDS,
        sums((lengths == 1).astype(np.float32), begin, end) / size, np.ones(len(begin), np.float32),
    ]
    out[full] = np.stack(columns, axis=1)
    return out, count


def encode(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    h = np.tanh(((x - p["mean"]) / p["scale"]) @ p["W"] + p["c"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    return h, t, g, (t * g) @ p["w"]


def attend(p: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray) -> tuple:
    """Log odds of each bag, with what the gradient needs."""
    h, t, g, energy = encode(p, x)
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), count)
    e = np.exp(energy - np.maximum.reduceat(energy, first)[owner])
    a = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first)
    return z @ p["o"] + p["b"], (h, t, g, a, z, owner, first)


def train(x: np.ndarray, count: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Encoder, gated attention and output fitted together on labelled bags; the start is seeded."""
    rng = np.random.default_rng(7)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    fixed = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 0.05}
    learned = {"W": draw(FEATURES, HIDDEN), "c": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES),
               "w": draw(GATES), "o": draw(HIDDEN), "b": np.zeros(1)}
    n = max(1, len(label))
    adam = Adam(learned, 0.02)
    scaled = (x - fixed["mean"]) / fixed["scale"]
    for _ in range(STEPS):
        p = fixed | learned
        odds, (h, t, g, a, z, owner, first) = attend(p, x, count)
        error = (sigmoid(odds) - label) / n
        dz = error[:, None] * p["o"]
        da = (dz[owner] * h).sum(axis=1)
        denergy = a * (da - np.add.reduceat(a * da, first)[owner])
        dt, dg = denergy[:, None] * g * p["w"] * (1 - t * t), denergy[:, None] * t * p["w"] * g * (1 - g)
        dh = (a[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        gradients = {"W": scaled.T @ dh, "c": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg,
                     "w": (t * g).T @ denergy, "o": z.T @ error, "b": np.array([error.sum()])}
        adam.update({k: v + 1e-5 * learned[k] for k, v in gradients.items()})
    return fixed | learned


def fit(sample: DataFrame) -> dict[str, np.ndarray]:
    """Parameters from (key, text, label); with one label or none the output is constant."""
    def run(batch):
        labels = batch.column("label")
        for begin, end, data, offsets in text_chunks(batch):
            x, count = passages(data, offsets)
            places = np.concatenate([[0], np.cumsum(count * FEATURES)]).astype(np.int32)
            yield {"label": labels.slice(begin, end - begin), "x": pa.ListArray.from_arrays(places, pa.array(x.reshape(-1)))}

    table = arrow(run, sample.select("key", "text", "label").repartition("key"), "label int, x array<float>").toArrow()
    label = table.column("label").to_numpy().astype(np.float64)
    if len(set(label.tolist())) < 2:
        sure = np.array([4.0 if len(label) and label[0] else -4.0])
        return {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "W": np.zeros((FEATURES, 1)), "c": np.zeros(1),
                "V": np.zeros((1, 1)), "U": np.zeros((1, 1)), "w": np.zeros(1), "o": np.zeros(1), "b": sure}
    lists = table.column("x").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    x = lists.flatten().to_numpy().astype(np.float64).reshape(-1, FEATURES)
    return train(x, np.diff(lists.offsets.to_numpy()) // FEATURES, label)


def score(docs: DataFrame, parameters: dict[str, np.ndarray], keep: str = "doc_id") -> DataFrame:
    """(``keep``, score, passages, attention): the score, and the largest weight of one passage."""
    shared = docs.sparkSession.sparkContext.broadcast(parameters)

    def run(batch):
        ids = batch.column(keep)
        for begin, end, data, offsets in text_chunks(batch):
            x, count = passages(data, offsets)
            odds, (_, _, _, a, _, _, first) = attend(shared.value, x.astype(np.float64), count)
            yield {keep: ids.slice(begin, end - begin), "score": sigmoid(odds), "passages": count,
                   "attention": np.maximum.reduceat(a, first)}

    rows = docs.select(F.col(keep).cast("long").alias(keep), text_or_empty())
    return arrow(run, rows, f"{keep} long, score double, passages long, attention double")


def quality(docs: DataFrame, labels: DataFrame, unseen: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages, attention) of every row of ``docs`` (doc_id, text).

    Learns from at most ``sample_rows`` labelled documents, none of them
    ``unseen`` (crc32 of the id modulo 4 is 2).  Passages are 64 words.  Null
    and empty texts are one passage of zeros; repeated rows get equal scores;
    null ids are not held out; with one label or none all scores lie on its
    side; an empty table gives no rows; other columns are not read.
    """
    unseen = held_out(F.col("doc_id"), 4, 2) if unseen is None else unseen
    parameters = fit(labelled_sample(docs, labels, "quality", unseen, sample_rows))
    return score(docs, parameters).select(
        "doc_id", unseen.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "passages", "attention")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they are.

    The model is that of ``quality``; rows are judged one by one, unshuffled.
    """
    unseen = held_out(F.col("doc_id"), 4, 2)
    parameters = fit(labelled_sample(docs, labels, "quality", unseen, sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast(parameters)

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for begin, end, data, offsets in text_chunks(batch):
                x, count = passages(data, offsets)
                odds = attend(shared.value, x.astype(np.float64), count)[0]
                keep[begin:end] = sigmoid(odds) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
