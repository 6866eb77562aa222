"""Bounded samples of labelled documents, for models that are trained on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from watchkeep.llm.common import store, text_or_empty

_SPAN = 1 << 20
MOST_CHARS = 100_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, unseen: Column, rows: int, chars: int = MOST_CHARS) -> DataFrame:
    """(key, text, label) of at most about ``rows`` labelled documents and ``chars`` characters.

    ``unseen`` marks ids that must not be learned from.  The share is chosen by
    a hash of the id, so a larger table gives other rows but not more.  An id
    has one text in the sample, the smallest, however many rows it has.  Ids
    with contradicting labels, and null ids or labels, are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~unseen).groupBy(
        F.col("doc_id").cast("long").alias("key")).agg(
        F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")).where("label = other").drop("other")
    share = min(1.0, rows / max(1, known.count()))
    place = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(_SPAN))
    chosen = store(known.where(place < int(share * _SPAN)), "labelled-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), text_or_empty()).join(chosen, "key")
    sample = store(texts.groupBy("key", "label").agg(F.min("text").alias("text")), "labelled")
    held = sample.agg(F.sum(F.length("text").cast("long")).alias("n")).head()["n"] or 0
    if held > chars:
        sample = sample.where((place < int(share * _SPAN * chars / held)) & (F.length("text") <= chars))
    return sample.select("key", "text", "label")


class Adam:
    """Adam steps over a dictionary of arrays, with the usual constants; in place, as new arrays cost more than the steps."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        zeros = lambda: {k: np.zeros_like(v) for k, v in parameters.items()}
        self.first, self.second, self.change, self.spread = zeros(), zeros(), zeros(), zeros()

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in gradients.items():
            first, second, change, spread = self.first[k], self.second[k], self.change[k], self.spread[k]
            np.subtract(g, first, out=change)
            change *= 0.1
            first += change
            np.multiply(g, g, out=spread)
            spread -= second
            spread *= 0.001
            second += spread
            np.divide(first, 1 - 0.9 ** self.step, out=change)
            np.divide(second, 1 - 0.999 ** self.step, out=spread)
            np.sqrt(spread, out=spread)
            spread += 1e-8
            change *= self.rate
            change /= spread
            self.parameters[k] -= change


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
