"""Beam search over candidates that rules make of one another, as tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.sources.shared import settled


def beam(seeds: DataFrame, expand: Callable[[DataFrame], DataFrame], key: Column, score: Column, columns: Sequence[str], rounds: int, per_parent: int, width: int, keep: Column | None = None) -> DataFrame:
    """(key, columns, parent, depth, score): the seeds, and what each round kept.

    A round expands the last one's candidates (their columns, and key), which gives rows with the columns and parent; key is a candidate's canonical
    form, so that one found again, in this round or an earlier one, is no new candidate. Of new ones that `keep` holds for, each parent
    keeps its best by score, and the round the best of all; ties go to the smaller key. Of parents that make the same
    candidate the smallest is named. Rounds are written, and end early where nothing new is found. Seeds may repeat; candidates without a key or score are none.
    """
    named = lambda df, *more: df.select(key.alias("key"), *columns, *more, score.cast("double").alias("score")).where("key IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    started = named(seeds)
    same = Window.partitionBy("key").orderBy(F.desc("score"), *columns)
    front = started.withColumn("__n", F.row_number().over(same)).where("__n = 1").select("key", *columns, F.lit(None).cast(dict(started.dtypes)["key"]).alias("parent"), F.lit(0).alias("depth"), "score")
    front = settled(front)
    seen = front
    once = Window.partitionBy("key").orderBy("parent", F.desc("score"), *columns)
    own = Window.partitionBy("parent").orderBy(F.desc("score"), "key")
    for depth in range(1, rounds + 1):
        made = named(expand(front.select("key", *columns)), "parent")
        if keep is not None:
            made = made.where(keep)
        new = made.withColumn("__n", F.row_number().over(once)).where("__n = 1").join(seen.select("key"), "key", "left_anti")
        best = new.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= per_parent)
        front = settled(best.orderBy(F.desc("score"), "key").limit(width).select("key", *columns, "parent", F.lit(depth).alias("depth"), "score"))
        if front.isEmpty():
            break
        seen = settled(seen.union(front))
    return seen
