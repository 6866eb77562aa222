"""Isolation forest (Liu, Ting, Zhou 2008): anomaly scores for log events.

Everything drawn comes from hashes, so a forest can be grown again by any
engine.  Rows have a place on a circle; a tree's sample is the 256 rows that
follow its own point there.  One comparison of a row's place leaves a few
thousand candidates for all trees together, however many rows there are.  The
trees grow in parallel, and scoring runs over Arrow batches.  A fitted forest
holds at most trees x 511 nodes and is broadcast.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from watchkeep import constants as C
from watchkeep.session import materialise

FEATURES = ["risk_score", "anomaly_score"]
DEFAULTS = [float(C.DEFAULT_RISK), C.DEFAULT_ANOMALY]
SAMPLE = 256
EULER = 0.5772156649015329
TREE = "tree int, node int, feature int, threshold double, path double"
CIRCLE = 1 << 31
SPARE = 4  # candidates for each place in a sample
DIGITS = 6  # decimals of a score


def features(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(n).cast("double"), F.lit(d)).alias(n) for n, d in zip(FEATURES, DEFAULTS)]


def expected_path(size: int) -> float:
    """Mean path length of an unsuccessful search among ``size`` rows."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (np.log(size - 1.0) + EULER) - 2.0 * (size - 1.0) / size


def _drawn(seed: int, tree: int, node: int, what: str) -> int:
    return int(hashlib.md5(f"{seed}:{tree}:{node}:{what}".encode()).hexdigest()[:8], 16)


def _grow(tree: int, points: np.ndarray, seed: int) -> pd.DataFrame:
    """Nodes are numbered as in a heap: the children of n are 2n and 2n + 1."""
    limit = depth_limit(len(points))
    nodes, pending = [], [(1, points, 0)]
    while pending:
        node, rows, depth = pending.pop()
        spread = [f for f in range(rows.shape[1]) if len(rows) and rows[:, f].min() < rows[:, f].max()]
        if depth >= limit or len(rows) <= 1 or not spread:
            nodes.append((tree, node, -1, 0.0, depth + expected_path(len(rows))))
            continue
        feature = spread[_drawn(seed, tree, node, "f") % len(spread)]
        low, high = rows[:, feature].min(), rows[:, feature].max()
        cut = low + (high - low) * (_drawn(seed, tree, node, "c") / 4294967296.0)
        cut = low if cut >= high else cut  # rounded up: both sides must have rows
        nodes.append((tree, node, feature, cut, 0.0))
        goes_left = rows[:, feature] <= cut
        pending += [(2 * node, rows[goes_left], depth + 1), (2 * node + 1, rows[~goes_left], depth + 1)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "path"])


def depth_limit(size: int) -> int:
    return int(np.ceil(np.log2(max(size, 2))))


def samples(rows: DataFrame, key: str, trees: int = C.FOREST_TREES, seed: int = C.FOREST_SEED) -> DataFrame:
    """(tree, id, features): the rows each tree grows from, at most 256, stored.

    ``key`` tells rows apart; equal keys share a place.
    """
    step = CIRCLE // trees
    count = rows.count()
    near = min(CIRCLE, -(-SPARE * SAMPLE * CIRCLE // max(1, count)))
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10)
    placed = rows.select(F.col(key).alias("id"), *features(rows), place.cast("bigint").alias("hash")).select(
        "id", *FEATURES, F.expr("hash div 2").alias("at"))
    if near < step:
        placed = placed.where(F.col("at") % step < near)
    behind = lambda t: F.pmod(F.col("at") - t * step, F.lit(CIRCLE))
    dealt = placed.withColumn("tree", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: behind(t) < near))).withColumn("behind", behind(F.col("tree")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("behind", "id"))
    return materialise(dealt.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("tree", "id", *FEATURES))


def grow_trees(sampled: DataFrame, seed: int = C.FOREST_SEED) -> DataFrame:
    """The nodes of all trees, from ``samples``."""
    def grow(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _grow(int(group[0]), pdf[FEATURES].to_numpy(float), seed)

    return sampled.groupBy("tree").applyInPandas(grow, TREE)


@dataclass
class Forest:
    """Node arrays of all trees by heap number, plus the score that separates the outliers."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    sample: int
    offset: float = -0.5

    def raw(self, points: np.ndarray) -> np.ndarray:
        """Negated anomaly score: lower is more anomalous.  Equal points are scored once."""
        points, back = np.unique(points, axis=0, return_inverse=True)
        depth = np.zeros(len(points))
        for feature, threshold, path in zip(self.feature, self.threshold, self.path):
            at = np.ones(len(points), dtype=np.int64)
            for _ in range(depth_limit(self.sample)):
                split = feature[at]
                value = points[np.arange(len(points)), np.maximum(split, 0)]
                at = np.where(split >= 0, 2 * at + (value > threshold[at]), at)
            depth += path[at]
        return -np.exp2(-depth / max(len(self.feature), 1) / max(expected_path(self.sample), 1e-9))[back.reshape(-1)]


def fit(rows: DataFrame, key: str, trees: int = C.FOREST_TREES, contamination: float = C.FOREST_CONTAMINATION,
        seed: int = C.FOREST_SEED) -> Forest:
    """Fit on ``rows``; the offset is the ``contamination`` quantile of the scores of all sampled rows."""
    sampled = samples(rows, key, trees, seed)
    nodes = grow_trees(sampled, seed).toPandas()  # at most trees x 511 rows
    points = sampled.select("id", *FEATURES).distinct().toPandas()[FEATURES].to_numpy(float)  # at most trees x 256
    size = min(SAMPLE, int(sampled.groupBy("tree").count().agg(F.max("count")).head()[0] or 0))
    shape = (trees, 2 << depth_limit(size))
    forest = Forest(np.full(shape, -1), np.zeros(shape), np.zeros(shape), size)
    at = (nodes["tree"].to_numpy(int), nodes["node"].to_numpy(int))
    forest.feature[at], forest.threshold[at], forest.path[at] = nodes["feature"], nodes["threshold"], nodes["path"]
    if len(points):
        forest.offset = float(np.sort(forest.raw(points))[max(0, int(np.ceil(contamination * len(points))) - 1)])
    return forest


def _raw_score(forest: Forest):
    @F.pandas_udf("double")
    def raw(risk: pd.Series, anomaly: pd.Series) -> pd.Series:
        return pd.Series(forest.raw(np.column_stack([risk.to_numpy(float), anomaly.to_numpy(float)])))

    return raw


def score(df: DataFrame, forest: Forest) -> DataFrame:
    """Adds ``forest_score`` in [0, 1], to six decimals; higher is more anomalous."""
    decision = _raw_score(forest)(*features(df)) - F.lit(forest.offset)
    return df.withColumn("forest_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - decision)), DIGITS))


def flag(scored: DataFrame, threshold: float = C.ANOMALY_THRESHOLD) -> DataFrame:
    return scored.withColumn("is_anomalous", F.col("forest_score") >= threshold)


def log_risk(scored: DataFrame) -> DataFrame:
    """Risk of a log raised by up to 40 for its anomaly score, at most 100."""
    raised = F.coalesce("risk_score", F.lit(C.DEFAULT_RISK)) + F.floor(F.col("forest_score") * 40)
    return scored.withColumn("log_risk", F.least(F.lit(100).cast("bigint"), raised).cast("int"))
