"""Layouts of vectors in two dimensions by their neighbour graph.

Each vector's nearest others, exactly found, are weighted by a fuzzy membership with a width of its own; the union of both directions
is the graph. Places start at the two first principal coordinates and move in rounds: neighbours attract each other, and a few others, drawn by a
hash of the row and the round, repel. A round is two joins and a sum by row over all rows at once, so that the layout is the same
on every run, whatever the partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.operators.joins import nearest_distances
from tessera.operators.models import from_array, projected
from tessera.operators.windows import placed
from tessera.sources.shared import settled


def curve(least: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + a d**(2 b)) is nearest to one below the least distance and falls off by the spread beyond it; least squares by Newton steps."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    goal = np.where(d < least, 1.0, np.exp(-(d - least) / spread))
    theta = np.array([0.5, 0.0])  # logarithms of a and b
    for _ in range(200):
        a, b = np.exp(theta)
        power = a * d ** (2 * b)
        made = 1 / (1 + power)
        slope = -(made**2)[:, None] * np.stack([power, power * 2 * b * np.log(d)], 1)
        step = np.linalg.solve(slope.T @ slope + 1e-6 * np.eye(2), slope.T @ (goal - made))
        theta = theta + np.clip(step, -0.5, 0.5)
    return float(np.exp(theta[0])), float(np.exp(theta[1]))


def memberships(distances: np.ndarray) -> np.ndarray:
    """How much each of a row's neighbours belongs to it: 1 for the nearest ones, and together the logarithm of their number; rows of ascending distances."""
    k = distances.shape[1]
    near = np.where(distances > 0, distances, np.inf).min(1, keepdims=True)
    over = np.maximum(distances - np.where(np.isfinite(near), near, 0.0), 0)
    low, high, width = np.zeros(len(over)), np.full(len(over), np.inf), np.ones(len(over))
    for _ in range(64):
        total = np.exp(-over / np.maximum(width, 1e-12)[:, None]).sum(1)
        large = total > np.log2(max(k, 2))
        high, low = np.where(large, width, high), np.where(large, low, width)
        width = np.where(np.isinf(high), 2 * width, (low + high) / 2)
    # A width has a floor, so that many repeats of a row do not cut it off from the others.
    return np.exp(-over / np.maximum(width, 1e-3 * np.maximum(distances.mean(1), 1e-12))[:, None])


def neighbour_graph(df: DataFrame, key: str, vector: str, k: int = 15, metric: str = "euclid", block_rows: int = 2048) -> DataFrame:
    """(a, b, w), a < b: the fuzzy union of each row's memberships in both directions."""
    near = nearest_distances(df, df, key, vector, k, metric, block_rows, named=True)

    def weigh(batches):
        for pdf in batches:
            for size, part in pdf.groupby(pdf["best"].map(len)):
                if size:
                    w = memberships(np.array([[x["d"] for x in best] for best in part["best"]]))
                    yield pd.DataFrame({"src": np.repeat(part["key"].to_numpy(), size), "dst": [x["key"] for best in part["best"] for x in best], "w": w.reshape(-1)})

    kind = dict(df.dtypes)[key]
    each = near.mapInPandas(weigh, f"src {kind}, dst {kind}, w double")
    both = each.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("x"), F.min("w").alias("y"), F.count("*").alias("n"))
    return both.select("a", "b", F.when(F.col("n") > 1, F.col("x") + F.col("y") - F.col("x") * F.col("y")).otherwise(F.col("x")).alias("w"))


def layout(df: DataFrame, key: str, vector: str, k: int = 15, least: float = 0.1, rounds: int = 40, negatives: int = 5, metric: str = "euclid", seed: int = 1, block_rows: int = 2048) -> DataFrame:
    """(key, x, y) of each row with a vector; keys are unique."""
    rows = settled(df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")))
    n = rows.count()
    if n < 3:
        return rows.select(F.col("key").alias(key), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    graph = settled(neighbour_graph(rows, "key", "v", min(k, n - 1), metric, block_rows))
    first = projected(from_array(rows, "v"), "features", 2, "pc").select("key", F.col("pc")[0].alias("x"), F.col("pc")[1].alias("y"))
    # Spread over a like extent whatever the vectors' scale; a hash keeps equal rows apart.
    wide = first.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1e-12))).first()[0]
    apart = lambda salt: F.pmod(F.xxhash64("key", F.lit(seed), F.lit(salt)), F.lit(2001)) / 1000.0 - 1
    now = settled(placed(first.select("key", (F.col("x") * (10 / wide) + 0.01 * apart("x")).alias("x"), (F.col("y") * (10 / wide) + 0.01 * apart("y")).alias("y")), ["key"], "at"))
    top = graph.agg(F.max("w")).first()[0]
    index = now.select("key", "at")
    ends = graph.join(index.select(F.col("key").alias("a"), F.col("at").alias("p")), "a").join(index.select(F.col("key").alias("b"), F.col("at").alias("q")), "b").select("p", "q", (F.col("w") / top).alias("w"))
    ties = settled(ends.union(ends.select("q", "p", "w")))
    pull = settled(ties.groupBy("p").agg(F.sum("w").alias("pull")))
    a, b = curve(least)
    for r in range(rounds):
        # Others to keep away from, a few for each row, as strongly as its neighbours draw it.
        drawn = pull.select("p", F.explode(F.array(*[F.pmod(F.xxhash64("p", F.lit(seed), F.lit(r), F.lit(s)), F.lit(n)) for s in range(negatives)])).alias("q"), (-F.col("pull")).alias("w")).where("p <> q")
        side = lambda name, own: own.select(F.col("at").alias(name), F.col("x").alias(f"x_{name}"), F.col("y").alias(f"y_{name}"))
        met = ties.union(drawn).join(side("p", now), "p").join(side("q", now), "q")
        dx, dy = F.col("x_p") - F.col("x_q"), F.col("y_p") - F.col("y_q")
        d2 = dx * dx + dy * dy
        draw = F.when(d2 > 0, -2 * a * b * F.pow(d2, F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b)))).otherwise(0.0)
        push = 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, F.lit(b))))
        force = F.when(F.col("w") > 0, F.col("w") * draw).otherwise(-F.col("w") * push)
        held = lambda f: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), f))
        moved = met.groupBy(F.col("p").alias("at")).agg(F.sum(held(force * dx)).alias("fx"), F.sum(held(force * dy)).alias("fy"))
        rate = 1.0 - r / rounds
        step = lambda c, f: (F.col(c) + rate * held(F.coalesce(f, F.lit(0.0)))).alias(c)
        now = settled(now.join(moved, "at", "left").select("at", "key", step("x", F.col("fx")), step("y", F.col("fy"))))
    return now.select(F.col("key").alias(key), "x", "y")


def neighbour_overlap(one: DataFrame, two: DataFrame, key: str, first: str, second: str, k: int, block_rows: int = 2048) -> DataFrame:
    """(overlap): the mean share of a row's k nearest others by one vector that are among those by the other."""
    near = lambda df, v: nearest_distances(df, df, key, v, k, "euclid", block_rows, named=True).select("key", F.transform("best", lambda x: x["key"]).alias(v))
    both = near(one, first).join(near(two, second).withColumnRenamed(second, "__other"), "key")
    return both.agg(F.avg(F.try_divide(F.size(F.array_intersect(first, "__other")).cast("double"), F.size(first))).alias("overlap"))
