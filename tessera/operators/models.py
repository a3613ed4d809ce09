"""Statistical models on Spark ML: scaling, projection, clustering scans, forests, blocked validation, ablation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.aggregates import auc, regression_errors
from tessera.operators.windows import blocks


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become medians, then each column is centred and divided by its population deviation (constant ones by one)."""
    stats = df.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]).first()
    full = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(stats[c] if stats[c] is not None else 0.0))) for c in columns})
    two = full.agg(*[f(c).alias(f"{n}_{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return full.withColumns({c: (F.col(c) - (two[f"m_{k}"] or 0.0)) / (two[f"s_{k}"] or 1.0) for k, c in enumerate(columns)})


def with_vector(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def from_array(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(column).cast("array<double>")))


def projected(df: DataFrame, features: str, k: int, name: str = "pc") -> DataFrame:
    """The first k principal coordinates as an array; features are centred first, as Spark's projection does not."""
    model = PCA(k=k, inputCol=features, outputCol="__pc").fit(df)
    n = df.select(features).first()[0].size
    mean = df.select(vector_to_array(features).alias("a")).agg(*[F.avg(F.col("a")[i]) for i in range(n)]).first()
    shift = np.array([m or 0.0 for m in mean]) @ model.pc.toArray()
    return model.transform(df).withColumn(name, F.zip_with(vector_to_array("__pc"), F.array(*[F.lit(float(s)) for s in shift]), lambda x, y: x - y)).drop("__pc")


def kmeans_scan(df: DataFrame, features: str, ks: Sequence[int], seed: int = 1) -> list[tuple[int, float]]:
    """(k, silhouette) of each k."""
    measure = ClusteringEvaluator(featuresCol=features, predictionCol="cluster")
    return [(k, measure.evaluate(KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df).transform(df))) for k in ks]


def clustered(df: DataFrame, features: str, k: int, seed: int = 1) -> DataFrame:
    """Clusters and the distance to the own centre; the nearest row of each is its medoid."""
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    gap = F.zip_with(vector_to_array(features), F.element_at(centres, F.col("cluster") + 1), lambda x, y: (x - y) * (x - y))
    return model.transform(df).withColumn("centre_distance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v)))


def medoid_table(clusters: DataFrame, key: str) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.min_by(key, F.struct("centre_distance", key)).alias("medoid"))


def folds(df: DataFrame, key: str, n: int, name: str = "fold") -> DataFrame:
    """A fold by hash of the key: the same on every run, and without a shuffle."""
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def out_of_fold_regression(df: DataFrame, features: str, target: str, key: str, n: int = 5, trees: int = 20, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(predictions of held-out rows, their errors) of random forests."""
    data = folds(df, key, n)
    parts = []
    for k in range(n):
        model = RandomForestRegressor(featuresCol=features, labelCol=target, numTrees=trees, seed=seed).fit(data.where(F.col("fold") != k))
        parts.append(model.transform(data.where(F.col("fold") == k)).select(key, target, "prediction"))
    made = parts[0]
    for p in parts[1:]:
        made = made.union(p)
    return made, regression_errors(made, "prediction", target)


def blended_classifier(df: DataFrame, features: str, label: str, key: str, n: int = 5, weights: tuple[float, float] = (0.7, 0.3), seed: int = 1) -> DataFrame:
    """(key, label, score): held-out scores of a forest and a logistic model, blended; folds are by class."""
    nth = F.row_number().over(Window.partitionBy(label, F.pmod(F.xxhash64(key), F.lit(64))).orderBy(F.xxhash64(key), key))
    data = df.withColumn("fold", F.pmod(nth + F.pmod(F.xxhash64(key), F.lit(64)), F.lit(n)).cast("int"))
    out = None
    for k in range(n):
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        a = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=20, seed=seed, probabilityCol="pa", rawPredictionCol="ra", predictionCol="ya").fit(train)
        b = LogisticRegression(featuresCol=features, labelCol=label, regParam=0.01, probabilityCol="pb", rawPredictionCol="rb", predictionCol="yb").fit(train)
        made = b.transform(a.transform(test)).select(key, label, (weights[0] * vector_to_array("pa")[1] + weights[1] * vector_to_array("pb")[1]).alias("score"))
        out = made if out is None else out.union(made)
    return out


def importances(df: DataFrame, columns: Sequence[str], label: str, dataset: str | None = None, seed: int = 1) -> list[tuple[str, str, float]]:
    """(dataset, feature, importance) of a forest for each dataset and for all of them together; datasets are few."""
    names = [r[0] for r in df.select(dataset).distinct().orderBy(dataset).collect()] if dataset else []
    out = []
    for name in [*names, "Combined"]:
        part = with_vector(df if name == "Combined" else df.where(F.col(dataset) == name), columns)
        model = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=20, seed=seed).fit(part)
        out += [(str(name), c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
    return out


def blocked_auc(df: DataFrame, columns: Sequence[str], label: str, order: Sequence[str], n: int = 5) -> DataFrame:
    """AUC of logistic models, each tested on one contiguous block and trained on the others."""
    data = with_vector(standardized(df, columns), columns)
    data = blocks(data, [], order, n)
    out = None
    for k in range(n):
        model = LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01).fit(data.where(F.col("block") != k))
        made = model.transform(data.where(F.col("block") == k)).select(label, vector_to_array("probability")[1].alias("score"))
        out = made if out is None else out.union(made)
    return auc(out, "score", F.col(label) == 1)


def ablation(df: DataFrame, groups: dict[str, Sequence[str]], label: str, order: Sequence[str], n: int = 5) -> list[tuple[str, float]]:
    """AUC with all feature groups, and without each."""
    every = [c for g in groups.values() for c in g]
    sets = {"all": every} | {f"without {g}": [c for c in every if c not in columns] for g, columns in groups.items() if len(columns) < len(every)}
    return [(name, blocked_auc(df, columns, label, order, n).first()["auc"]) for name, columns in sets.items()]


def frontier(df: DataFrame, terms: dict[str, Column], weights: dict[str, float], n: int, tie: Sequence[str]) -> DataFrame:
    """The n rows with the largest weighted sum of terms."""
    return df.withColumns(terms).withColumn("frontier_score", sum((F.col(t) * w for t, w in weights.items()), F.lit(0.0))).orderBy(F.desc("frontier_score"), *tie).limit(n)


def phase_weights(iteration: int, scored: int) -> dict[str, float]:
    """Term weights of the early, late and balanced phases."""
    names = ("novelty", "uncertainty", "quality", "druglike", "reference", "contact")
    early, late, balanced = (0.38, 0.24, 0.10, 0.12, 0.08, 0.08), (0.18, 0.30, 0.26, 0.10, 0.08, 0.08), (0.28, 0.24, 0.18, 0.12, 0.09, 0.09)
    return dict(zip(names, early if iteration <= 3 else late if scored > 200 else balanced, strict=True))
