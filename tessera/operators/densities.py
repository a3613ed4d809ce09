"""Grids and densities: histograms, gap maps, smoothing, free energies."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: the gas constant in kcal per mole and kelvin.
GAS = 0.00198720425864083


def cell(c: Column, low: Column, high: Column, bins: int) -> Column:
    """The grid cell of a value between bounds; the last cell is closed."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.least(F.lit(bins - 1), F.floor((c - low) / span * bins).cast("int"))


def histogram(df: DataFrame, x: str, y: str, bins: int, values: Sequence[Column] = ()) -> DataFrame:
    """(ix, iy, n, ...) of all bins * bins cells, empty ones too; bounds are one broadcast row."""
    bounds = df.agg(F.min(x).cast("double").alias("x0"), F.max(x).cast("double").alias("x1"), F.min(y).cast("double").alias("y0"), F.max(y).cast("double").alias("y1"))
    each = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(bounds)).withColumns({"ix": cell(F.col(x), F.col("x0"), F.col("x1"), bins), "iy": cell(F.col(y), F.col("y0"), F.col("y1"), bins)})
    counted = each.groupBy("ix", "iy").agg(F.count("*").alias("n"), *values)
    axis = lambda name: df.sparkSession.range(bins).select(F.col("id").cast("int").alias(name))
    return axis("ix").crossJoin(axis("iy")).join(counted, ["ix", "iy"], "left").na.fill(0, ["n"])


def gap_map(df: DataFrame, x: str, y: str, score: str, predicted: str, bins: int) -> DataFrame:
    """Counts, scored counts, mean scores and gap priority 1 / (1 + count) + 0.25 [any scored] of every cell."""
    grid = histogram(df, x, y, bins, [F.count(score).alias("scored"), F.avg(score).alias("mean_score"), F.avg(predicted).alias("mean_predicted")]).na.fill(0, ["scored"])
    return grid.withColumn("priority", 1 / (1 + F.col("n")) + 0.25 * (F.col("scored") > 0).cast("int"))


def grid_metrics(grid: DataFrame) -> DataFrame:
    return grid.agg(F.count_if(F.col("n") > 0).alias("occupied"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("empty"))


def free_energy(grid: DataFrame, temperature: float = 300.0, value: str = "n") -> DataFrame:
    """-kT ln p of each cell less the least one; null where a cell is empty."""
    every = Window.partitionBy()  # bins * bins rows, whatever the data
    p = F.col(value) / F.sum(value).over(every)
    raw = F.when(F.col(value) > 0, -GAS * temperature * F.log(p))
    return grid.withColumn("__f", raw).withColumn("energy", F.col("__f") - F.min("__f").over(every)).drop("__f")


def smoothed(grid: DataFrame, sigma: float, bins: int, clamp: bool = False, least: int = 3, value: str = "n") -> DataFrame:
    """(ix, iy, smooth): Gaussian smoothing of cells, zero beyond the edges or with the edge cells repeated. Cells are spread over offsets, so the join is by cell."""
    radius = max(least, round(4 * sigma))
    weights = [exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = F.array(*[F.struct(F.lit(k).alias("d"), F.lit(w / sum(weights)).alias("w")) for k, w in zip(range(-radius, radius + 1), weights, strict=True)])

    def along(df: DataFrame, axis: str, other: str) -> DataFrame:
        if not clamp:
            each = df.select(other, F.col(axis).alias("at"), value, F.explode(kernel).alias("k"))
            return each.select(other, (F.col("at") + F.col("k")["d"]).alias(axis), (F.col(value) * F.col("k")["w"]).alias(value)).where(F.col(axis).between(0, bins - 1)).groupBy(axis, other).agg(F.sum(value).alias(value))
        targets = df.select(F.col(axis).alias("to"), other, F.explode(kernel).alias("k")).select("to", other, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.col("to") + F.col("k")["d"])).alias(axis), F.col("k")["w"].alias("w"))
        return targets.join(df, [axis, other]).groupBy(F.col("to").alias(axis), other).agg(F.sum(F.col(value) * F.col("w")).alias(value))

    start = grid.select("ix", "iy", F.col(value).cast("double").alias(value))
    return along(along(start, "ix", "iy"), "iy", "ix").select("ix", "iy", F.col(value).alias("smooth"))


def gap_regions(df: DataFrame, x: str, y: str, bins: int = 20, most: int = 1) -> DataFrame:
    """Cells of a padded grid with at most `most` points, and the distance from the centre to the nearest occupied cell's mean point."""
    pad = lambda lo, hi: (lo - (hi - lo) * 0.05 - 1e-6, hi + (hi - lo) * 0.05 + 1e-6)
    b = df.agg(F.min(x).cast("double").alias("x0"), F.max(x).cast("double").alias("x1"), F.min(y).cast("double").alias("y0"), F.max(y).cast("double").alias("y1"))
    (xl, xh), (yl, yh) = pad(F.col("x0"), F.col("x1")), pad(F.col("y0"), F.col("y1"))
    b = b.select(xl.alias("xl"), xh.alias("xh"), yl.alias("yl"), yh.alias("yh"))
    placed = df.crossJoin(F.broadcast(b)).withColumns({"ix": cell(F.col(x), F.col("xl"), F.col("xh"), bins), "iy": cell(F.col(y), F.col("yl"), F.col("yh"), bins)})
    cells = placed.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    axis = lambda name: df.sparkSession.range(bins).select(F.col("id").cast("int").alias(name))
    full = axis("ix").crossJoin(axis("iy")).crossJoin(F.broadcast(b)).join(cells, ["ix", "iy"], "left").na.fill(0, ["n"])
    centre = full.where(F.col("n") <= most).select("ix", "iy", "n", (F.col("xl") + (F.col("ix") + 0.5) * (F.col("xh") - F.col("xl")) / bins).alias("cx"), (F.col("yl") + (F.col("iy") + 0.5) * (F.col("yh") - F.col("yl")) / bins).alias("cy"))
    # At most bins * bins rows on either side.
    met = centre.crossJoin(F.broadcast(cells.select("mx", "my"))).groupBy("ix", "iy", "n", "cx", "cy").agg(F.min(F.hypot(F.col("cx") - F.col("mx"), F.col("cy") - F.col("my"))).alias("distance"))
    return met
