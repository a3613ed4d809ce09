"""Exact Shapley values of a forest's predictions, row by row, with what a tree does not know averaged over its training rows.

A tree is taken as its paths: a leaf's value, the range that each feature on the way must lie in, and the share of the training
rows that would go that way if the feature were not known. What a path gives to a feature depends on which of its ranges the row lies in
and on nothing else, so that all that a path can give stands in a table by the pattern of ranges met; a row looks its patterns up.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Features of a path whose patterns are tabled, and rows that are looked up at a time.
TABLED, ROWS = 10, 256


@dataclass
class Path:
    """A leaf: its value, and the features on its path with their ranges (low, high] and the shares that go on without knowing them."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def _leaf_value(node, label: int | None) -> float:
    """A node's prediction, or the share of a class among its rows."""
    if label is None:
        return float(node.prediction())
    stats = list(node.impurityStats().stats())
    return float(stats[label] / sum(stats))


def tree_paths(root, label: int | None = None) -> Iterator[Path]:
    """The paths of a tree of Spark ML, from its root node."""
    stack = [(root, {})]
    while stack:
        node, ranges = stack.pop()
        if node.subtreeDepth() == 0:
            names = sorted(ranges)
            rows = np.array([ranges[f] for f in names], float).reshape(len(names), 3)
            yield Path(_leaf_value(node, label), np.array(names, int), rows[:, 0], rows[:, 1], rows[:, 2])
            continue
        split, whole = node.split(), node.impurityStats().count()
        if not hasattr(split, "threshold") or split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("a split on categories has no range")
        f, at = split.featureIndex(), split.threshold()
        low, high, share = ranges.get(f, (-math.inf, math.inf, 1.0))
        left, right = node.leftChild(), node.rightChild()
        stack.append((right, ranges | {f: (max(low, at), high, share * right.impurityStats().count() / whole)}))
        stack.append((left, ranges | {f: (low, min(high, at), share * left.impurityStats().count() / whole)}))


def forest_paths(model, label: int | None = None) -> list[Path]:
    """The paths of all trees of a fitted forest, or of one tree; values are weighted so that they add up to the forest's prediction."""
    trees = getattr(model, "trees", [model])
    out = []
    for tree in trees:
        for p in tree_paths(tree._java_obj.rootNode(), label):
            out.append(Path(p.value / len(trees), p.features, p.low, p.high, p.share))
    return out


def given(met: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What paths of the same length give to each of their features: met (..., m) says which ranges are met, share (..., m).

    Over the subsets of a path's other features, taken as known or not, the path is reached with the product of met (known) and share (unknown).
    Summed by the subsets' size these products are the coefficients of a polynomial; the sizes' weights are those of Shapley.
    """
    m = met.shape[-1]
    weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    out = np.empty(met.shape)
    for i in range(m):
        poly = np.zeros((*met.shape[:-1], m))
        poly[..., 0] = 1
        for j in range(m):
            if j != i:
                known = np.zeros_like(poly)
                known[..., 1:] = poly[..., :-1] * met[..., j, None]
                poly = poly * share[..., j, None] + known
        out[..., i] = value * (met[..., i] - share[..., i]) * (poly @ weight)
    return out


class Forest:
    """Paths by their number of features, with what they give."""

    def __init__(self, paths: list[Path], width: int):
        self.width = width
        self.base = float(sum(p.value * p.share.prod() for p in paths))
        self.groups = []
        for m in sorted({len(p.features) for p in paths} - {0}):
            mine = [p for p in paths if len(p.features) == m]
            features, low, high, share = (np.stack([getattr(p, n) for p in mine]) for n in ("features", "low", "high", "share"))
            value = np.array([p.value for p in mine])
            table = None
            if m <= TABLED:
                met = np.array(list(itertools.product((0.0, 1.0), repeat=m)))
                table = given(np.broadcast_to(met, (len(mine), *met.shape)), share[:, None, :], value[:, None])
            self.groups.append((features, low, high, share, value, table))

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """A row of the features' shares in the prediction for each row of x."""
        out = np.zeros((len(x), self.width))
        for features, low, high, share, value, table in self.groups:
            n, m = features.shape
            for at in range(0, len(x), ROWS):
                own = x[at : at + ROWS][:, features]
                # As the trees do: what is not known to lie at or below a threshold goes right.
                met = ~(own <= low) & ((own <= high) | np.isinf(high))
                if table is None:
                    each = given(met.astype(float), np.broadcast_to(share, met.shape), value)
                else:
                    each = table[np.arange(n), met @ (1 << np.arange(m)[::-1])]
                for k in range(m):
                    np.add.at(out[at : at + ROWS].T, features[:, k], each[:, :, k].T)
        return out


def attributed(df: DataFrame, model, features: Sequence[str], label: int | None = None, prefix: str = "shap_") -> DataFrame:
    """The rows with base, a column of each feature's share, and prediction: base and shares add up to it. For a classifier, of the probability of a class.

    The model's paths go to every task: they are as large as the model. Null features count as missing, and go as the trees send them.
    """
    forest = Forest(forest_paths(model, label), len(features))
    shared = df.sparkSession.sparkContext.broadcast(forest)
    kind = "array<double>"

    @F.pandas_udf(kind)
    def shares(rows: pd.Series) -> pd.Series:
        x = np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(len(rows), len(features))
        return pd.Series(list(shared.value.attributions(x)), dtype=object)

    made = df.withColumn("__shares", shares(F.array(*[F.col(f).cast("double") for f in features])))
    each: list[Column] = [F.col("__shares")[k].alias(f"{prefix}{f}") for k, f in enumerate(features)]
    total = F.lit(forest.base) + F.aggregate("__shares", F.lit(0.0), lambda s, v: s + v)
    return made.select(*[F.col(c) for c in df.columns], F.lit(forest.base).alias("base"), *each, total.alias("prediction"))


def mean_attributions(rows: DataFrame, features: Sequence[str], prefix: str = "shap_") -> DataFrame:
    """(feature, mean, mean_size): each feature's mean share and mean size of it, over attributed rows."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{prefix}{f}").alias("v")) for f in features])).alias("s")).select("s.*")
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), F.avg(F.abs("v")).alias("mean_size"))
