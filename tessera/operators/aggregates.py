"""Aggregations over labelled, measured rows: sweeps, bins, fractions, quantiles, correlations, effect sizes, agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.windows import running_total
from tessera.sources.shared import settled

COUNT = "n"


def _label_counts(label: str, labels: Sequence[str]) -> list[Column]:
    out = [F.count("*").alias(COUNT)]
    for x in labels:
        hits = F.count_if(F.col(label) == x)
        out += [hits.alias(f"{x}_n"), F.try_divide(hits.cast("double"), F.count("*")).alias(f"{x}_fraction")]
    return out


def label_fractions(df: DataFrame, keys: Sequence[str], label: str, labels: Sequence[str]) -> DataFrame:
    """Count, and count and fraction of each label, by key."""
    return df.groupBy(*keys).agg(*_label_counts(label, labels))


def threshold_sweep(df: DataFrame, value: str, cutoffs: Sequence[float], label: str, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Label fractions of the rows at or below each cutoff; a row counts under every cutoff that it meets.

    A row adds to its smallest cutoff only; the sweep is a running sum over at most as many rows as there are cutoffs a key.
    """
    steps = sorted(float(c) for c in cutoffs)
    bucket = reduce(lambda acc, c: F.when(F.col(value) <= c, F.lit(c)).otherwise(acc), reversed(steps), F.lit(None).cast("double"))
    counted = df.groupBy(*keys, bucket.alias("cutoff")).agg(F.count("*").alias(COUNT), *[F.count_if(F.col(label) == x).alias(f"{x}_n") for x in labels]).where("cutoff IS NOT NULL")
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    frame = groups.select("*", F.explode(F.array(*[F.lit(c) for c in steps])).alias("cutoff"))
    full = frame.join(counted, [*keys, "cutoff"], "left").na.fill(0, [COUNT, *[f"{x}_n" for x in labels]])
    run = Window.partitionBy(*keys).orderBy("cutoff")
    summed = full.select(*keys, "cutoff", *[F.sum(c).over(run).alias(c) for c in (COUNT, *[f"{x}_n" for x in labels])])
    return summed.select(*keys, "cutoff", COUNT, *[c for x in labels for c in (F.col(f"{x}_n"), F.try_divide(F.col(f"{x}_n").cast("double"), F.col(COUNT)).alias(f"{x}_fraction"))])


def named_ranges(df: DataFrame, ranges: Mapping[str, Column], value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median and spread of a value in each named, possibly overlapping, range."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in ranges.items()]))
    each = df.select(*keys, value, F.explode(names).alias("range"))
    x = F.col(value)
    main = each.groupBy(*keys, "range").agg(F.count("*").alias(COUNT), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_samp(value).alias("sd"))
    # Medians from counts by value, so that no task holds a range's values; rows are counted before they are told apart by range.
    counts = df.where(x.isNotNull()).groupBy(*keys, x.alias("__x"), names.alias("__names")).agg(F.count("*").alias("__n"))
    counts = counts.select(*keys, F.col("__x").alias(value), F.explode("__names").alias("range"), "__n")
    middle = ordered_quantiles(counts, value, [0.5], [*keys, "range"], "__n").withColumnsRenamed({k: f"__{k}" for k in (*keys, "range")})
    same = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, "range")])
    return main.join(middle, same, "left").select(*keys, "range", COUNT, "mean", F.col("q50").alias("median"), "low", "high", "sd")


def binned(df: DataFrame, value: str, edges: Sequence[float], label: str, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Label fractions in right-open bins, the last without an end; empty bins are rows too, values below the first edge none.

    share is the bin's part of all the key's rows, those outside every bin included.
    """
    e = sorted(float(x) for x in edges)
    place = reduce(lambda acc, k: F.when(F.col(value) >= e[k], F.lit(k)).otherwise(acc), range(len(e)), F.lit(None).cast("int"))
    each = df.select(*keys, label, place.alias("bin"))
    counted = each.groupBy(*keys, "bin").agg(F.count("*").alias(COUNT), *[F.count_if(F.col(label) == x).alias(f"{x}_n") for x in labels])
    totals = counted.groupBy(*keys).agg(F.sum(COUNT).alias("total"))
    frame = totals.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(x).alias("low")) for k, x in enumerate(e)])).alias("b")).select(*keys, "total", "b.*")
    full = frame.join(counted, [*keys, "bin"], "left").na.fill(0, [COUNT, *[f"{x}_n" for x in labels]])
    fractions = [F.try_divide(F.col(f"{x}_n").cast("double"), F.col(COUNT)).alias(f"{x}_fraction") for x in labels]
    return full.select(*keys, "bin", "low", COUNT, F.try_divide(F.col(COUNT).cast("double"), F.col("total")).alias("share"), *[f"{x}_n" for x in labels], *fractions)


def top_n_summaries(df: DataFrame, value: str, sizes: Sequence[int], label: str, labels: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Label fractions of the rows with the n smallest values, for each n. Only the largest n rows are ranked."""
    most = df.orderBy(F.col(value).asc_nulls_last(), *tie).limit(max(sizes))
    ranked = most.withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).asc_nulls_last(), *tie)))
    each = ranked.select(label, value, F.explode(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n >= F.col("rank"))).alias("top"))
    return each.groupBy("top").agg(*_label_counts(label, labels), F.max(value).alias("reach"))


def three_way_fractions(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of pairs, over all rows, over those of a, over those of b: marginals come from the counts, not the rows."""
    counts = df.groupBy(a, b).agg(F.count("*").alias(COUNT))
    of = lambda *k: F.sum(COUNT).over(Window.partitionBy(*k))
    return counts.select(a, b, COUNT, (F.col(COUNT) / of(F.lit(1))).alias("of_all"), (F.col(COUNT) / of(a)).alias(f"of_{a}"), (F.col(COUNT) / of(b)).alias(f"of_{b}"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[object], normal: bool = False) -> DataFrame:
    """Counts of row by column value, zeros filled; or their shares of the row."""
    table = df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values])
    if not normal:
        return table
    total = reduce(lambda x, y: x + y, [F.col(f"{column}_{v}") for v in values])
    return table.select(row, *[F.try_divide(F.col(f"{column}_{v}").cast("double"), total).alias(f"{column}_{v}") for v in values])


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    out = df.groupBy(column).agg(F.count("*").alias(COUNT)).orderBy(F.desc(COUNT), F.asc_nulls_last(column))
    return out.limit(most) if most else out


def quantiles(df: DataFrame, value: str, at: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, as columns q10, q25 and so on."""
    made = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in at])).alias("q"))
    return made.select(*keys, *[F.col("q")[k].alias(f"q{round(100 * p)}") for k, p in enumerate(at)])


def _upto(counts: DataFrame, keys: Sequence[str], value: str, amount: str, name: str) -> DataFrame:
    """The counts with the amount up to each value of its key: ranges of keys and values are added up side by side, however many values a key has."""
    rows = running_total(counts, [*keys, value], amount, "__run")
    if not keys:
        return rows.withColumnRenamed("__run", name)
    first = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(F.col("__run") - F.col(amount)).alias("__base"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(first, same).withColumn(name, F.col("__run") - F.col("__base")).drop("__run", "__base", *[f"__{k}" for k in keys])


def ordered_quantiles(df: DataFrame, value: str, at: Sequence[float], keys: Sequence[str] = (), amount: str | None = None) -> DataFrame:
    """quantiles() of groups of any size: from counts by value, sorted over all tasks, so that no task holds a group's values. With an amount a row stands for so many."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(amount) if amount else F.count("*")).alias("__c"))
    rows = _upto(counts, keys, value, "__c", "__upto")
    totals = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max("__upto").alias("__all"))
    if keys:
        rows = rows.join(totals, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]))
    else:
        rows = rows.crossJoin(F.broadcast(totals))  # one row
    place = lambda p: (F.col("__all") - 1) * F.lit(float(p))
    has = lambda i: (F.col("__upto") > i) & (F.col("__upto") - F.col("__c") <= i)
    out = []
    for p in at:
        low, high = (F.min(F.when(has(f(place(p))), F.col(value).cast("double"))) for f in (F.floor, F.ceil))
        part = F.max(place(p) - F.floor(place(p)))
        out.append((low + (high - low) * part).alias(f"q{round(100 * p)}"))
    return rows.groupBy(*keys).agg(*out)


def ranked_quantile(df: DataFrame, value: str, at: float, keys: Sequence[str] = (), floor: bool = False) -> DataFrame:
    """The value at index round((n - 1) p), half to even, of the sorted values; or at floor(n p). Ranks come from counts by value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    if keys:
        run, all_ = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
        placed = counts.withColumns({"upto": F.sum("c").over(run), "total": F.sum("c").over(all_)})
    else:
        placed = running_total(counts, [value], "c", "upto")
        placed = placed.crossJoin(F.broadcast(placed.agg(F.max("upto").alias("total"))))  # one row
    index = F.least(F.floor(F.col("total") * at), F.col("total") - 1) if floor else F.bround((F.col("total") - 1) * at, 0)
    return placed.where(F.col("upto") > index).groupBy(*keys).agg(F.min(value).alias("quantile"))


def group_summary(df: DataFrame, keys: Sequence[str], value: str, other: str, mode_of: str) -> DataFrame:
    """Count, different values of other, mean, median, both deviations, and the smallest most frequent value of mode_of; null keys are groups."""
    counts = df.groupBy(*keys, mode_of).agg(F.count("*").alias("c")).where(F.col(mode_of).isNotNull())
    modes = counts.groupBy(*keys).agg(F.min_by(mode_of, F.struct(-F.col("c"), F.col(mode_of))).alias("mode"))
    main = df.groupBy(*keys).agg(
        F.count("*").alias(COUNT), F.count_distinct(other).alias("different"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.stddev_pop(value).alias("sd_pop"), F.stddev_samp(value).alias("sd_samp"), F.min(value).alias("low"), F.max(value).alias("high"),
    )
    same = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return main.alias("l").join(modes.alias("r"), same, "left").select("l.*", "r.mode")


def circular(df: DataFrame, degrees: str, keys: Sequence[str] = ()) -> DataFrame:
    """Circular mean, from 0 to 360, and resultant length."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    return df.groupBy(*keys).agg(F.count(degrees).alias(COUNT), F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)).alias("mean_angle"), F.hypot(s, c).alias("resultant"))


def guarded_corr(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation; null under `least` complete pairs or where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    bottom = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when((F.count(a) >= least) & (bottom > 1e-300), F.try_divide(F.covar_pop(a, b), bottom))


def average_rank(value: str, keys: Sequence[str] = ()) -> Column:
    """Rank from 1 on, ties sharing their mean; both windows use one sort."""
    order = Window.partitionBy(*keys).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The rows with a value, and its average_rank(), from counts by value: for keys with very many rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    ranks = _upto(counts, keys, value, "__c", "__upto").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("__v"), (F.col("__upto") - (F.col("__c") - 1) / 2).alias(name))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col(value) == F.col("__v"))
    return df.join(ranks, same).drop("__v", *[f"__{k}" for k in keys])


def correlation_table(df: DataFrame, metrics: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson and Spearman correlation of each metric with the target, over the pairs that are complete."""
    long = df.select(*keys, F.col(target).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("m"))
    long = long.select(*keys, "y", "m.*").where("x IS NOT NULL AND y IS NOT NULL")
    if keys:
        ranked = long.withColumns({"rx": average_rank("x", [*keys, "metric"]), "ry": average_rank("y", [*keys, "metric"])})
    else:
        ranked = with_average_rank(with_average_rank(long, ["metric"], "x", "rx"), ["metric"], "y", "ry")
    return ranked.groupBy(*keys, "metric").agg(F.count("*").alias(COUNT), guarded_corr(F.col("x"), F.col("y")).alias("pearson"), guarded_corr(F.col("rx"), F.col("ry")).alias("spearman"))


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope, intercept and R2; null under two points or where x (for R2: y) is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    va, vb, cov = F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)
    slope = F.when((F.count(a) >= 2) & (va > 0), F.try_divide(cov, va))
    return df.groupBy(*keys).agg(F.count(a).alias(COUNT), slope.alias("slope"), (F.avg(b) - slope * F.avg(a)).alias("intercept"), F.when((va > 0) & (vb > 0), F.try_divide(cov * cov, va * vb)).alias("r2"))


def ends_by_time(df: DataFrame, time: str, value: str, keys: Sequence[str], early: float = 0.1) -> DataFrame:
    """First and last value, and the mean of the first part (rounded up) of the rows by time."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"r": F.row_number().over(w.orderBy(time, value)), "n": F.count("*").over(w)})
    return ranked.groupBy(*keys).agg(F.min_by(value, "r").alias("first"), F.max_by(value, "r").alias("last"), F.avg(F.when(F.col("r") <= F.ceil(F.col("n") * early), F.col(value))).alias("reference"))


def support(df: DataFrame, keys: Sequence[str], score: str, similarity: str) -> DataFrame:
    """Sum of scores weighted by positive similarities, and their count."""
    return df.groupBy(*keys).agg(F.sum(F.col(score) * F.greatest(F.col(similarity), F.lit(0.0))).alias("support"), F.count_if(F.col(similarity) > 0).alias("supporters"))


def joined_distinct(df: DataFrame, keys: Sequence[str], value: str, order: str, separator: str = ";") -> DataFrame:
    """Different values by their first appearance in order, joined."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v"))))
    return first.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["v"]), separator).alias("joined"))


def with_group_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys)))


def merged_sets(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), ";").alias("members"))


def effect_sizes(df: DataFrame, features: Sequence[str], positive: Column) -> DataFrame:
    """Cohen's d (pooled sample variance; 0 under 1e-12), and the difference over the root mean of population variances, by feature."""
    rows = df.select(positive.alias("p"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f")).select("p", "f.*")
    a, b = F.when(F.col("p"), F.col("x")), F.when(~F.col("p"), F.col("x"))
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(F.try_divide((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), na + nb - 2))
    gap, plain = F.avg(a) - F.avg(b), F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
    safe = lambda d: F.when(d > 1e-12, F.try_divide(gap, d)).otherwise(F.lit(0.0))
    return rows.groupBy("feature").agg(na.alias("n_pos"), nb.alias("n_neg"), safe(pooled).alias("cohen_d"), safe(plain).alias("plain_d"))


def contact_enrichment(df: DataFrame, distance: str, feature: str, contact: Column, low: float = 0.1, high: float = 0.5) -> DataFrame:
    """By feature: contact frequency among short distances less that among long ones, times a positive rank correlation of contact and closeness."""
    # Everything comes from counts of equal rows: no task sorts a feature's rows, or holds all distances.
    g = settled(df.groupBy(F.col(feature).alias("f"), F.col(distance).cast("double").alias("d"), contact.cast("double").alias("c")).agg(F.count("*").alias("n")))
    cut = ordered_quantiles(g, "d", [low, high], (), "n").toDF("q_low", "q_high")

    def ranks(value: str) -> DataFrame:
        counts = g.groupBy("f", value).agg(F.sum("n").alias("m"))
        return _upto(counts, ["f"], value, "m", "upto").select(F.col("f").alias("__f"), F.col(value).alias("__v"), (F.col("upto") - (F.col("m") - 1) / 2).alias(f"r{value}"))

    same = lambda value: F.col("f").eqNullSafe(F.col("__f")) & F.col(value).eqNullSafe(F.col("__v"))
    ranked = g.join(ranks("d"), same("d")).drop("__f", "__v").join(ranks("c"), same("c")).drop("__f", "__v")
    total = g.groupBy(F.col("f").alias("__f")).agg(F.sum("n").alias("all"))
    # Ranks that ties share have the mean of all places.
    x, y, w = F.col("rd") - (F.col("all") + 1) / 2, F.col("rc") - (F.col("all") + 1) / 2, F.col("n") / F.col("all")
    rows = ranked.join(total, F.col("f").eqNullSafe(F.col("__f"))).crossJoin(F.broadcast(cut))  # one row of bounds
    mean = lambda met: F.try_divide(F.sum(F.when(met & F.col("c").isNotNull(), F.col("n") * F.col("c"))), F.sum(F.when(met & F.col("c").isNotNull(), F.col("n"))).cast("double"))
    short, long = mean(F.col("d") <= F.col("q_low")), mean(F.col("d") >= F.col("q_high"))
    bottom = F.sqrt(F.sum(w * x * x) * F.sum(w * y * y))
    rho = -F.when((F.max("all") >= 3) & (bottom > 1e-300), F.try_divide(F.sum(w * x * y), bottom))
    out = rows.groupBy(F.col("f").alias(feature)).agg(short.alias("short"), long.alias("long"), F.coalesce(rho, F.lit(0.0)).alias("rho"))
    return out.withColumn("enrichment", (F.coalesce("short", F.lit(0.0)) - F.coalesce("long", F.lit(0.0))) * F.greatest(F.lit(0.0), F.col("rho")))


def cluster_quality(df: DataFrame, cluster: str, label: str, positive: object, noise: object = -1) -> DataFrame:
    """Clusters, coverage, purity, and the size-weighted and largest departure of the positive share from its overall share; noise left out."""
    counts = df.groupBy(cluster, label).agg(F.count("*").alias("c"))
    valid = F.col(cluster) != noise
    by = counts.where(valid).groupBy(cluster).agg(F.sum("c").alias("size"), F.max("c").alias("top"), F.sum(F.when(F.col(label) == positive, F.col("c")).otherwise(0)).alias("pos"))
    whole = counts.agg(F.sum("c").alias("all"), F.sum(F.when(F.col(label) == positive, F.col("c")).otherwise(0)).alias("pos_all"))
    each = by.crossJoin(F.broadcast(whole)).withColumn("gap", F.abs(F.col("pos") / F.col("size") - F.col("pos_all") / F.col("all")))  # one row of totals
    out = each.groupBy("all").agg(
        F.count("*").alias("clusters"), (F.sum("size") / F.max("all")).alias("coverage"), (F.sum("top") / F.sum("size")).alias("purity"),
        (F.sum(F.col("gap") * F.col("size")) / F.sum("size")).alias("weighted_gap"), F.max("gap").alias("largest_gap"),
    )
    return out.drop("all").withColumn("score", F.col("weighted_gap") * F.col("coverage") * F.log(1.0 + F.col("clusters")))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalized mutual information (arithmetic mean) and adjusted Rand index of two labellings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("c"))
    of = lambda k: cells.groupBy(k).agg(F.sum("c").alias("m"))
    pairs = lambda x: x * (x - 1) / 2
    total = cells.agg(F.sum("c").cast("double").alias("n"))
    joint = cells.join(of(a).withColumnRenamed("m", "ma"), a).join(of(b).withColumnRenamed("m", "mb"), b).crossJoin(F.broadcast(total))  # one row of totals
    mi = F.sum(F.col("c") / F.col("n") * F.log(F.col("n") * F.col("c") / (F.col("ma") * F.col("mb"))))
    core = joint.agg(mi.alias("mi"), F.sum(pairs(F.col("c"))).alias("both"), F.max("n").alias("n"))
    side = lambda k: of(k).crossJoin(F.broadcast(total)).agg((-F.sum(F.col("m") / F.col("n") * F.log(F.col("m") / F.col("n")))).alias(f"h_{k}"), F.sum(pairs(F.col("m"))).alias(f"p_{k}"))
    row = core.crossJoin(side(a)).crossJoin(side(b))  # each a single row
    expected = F.try_divide(F.col(f"p_{a}") * F.col(f"p_{b}"), pairs(F.col("n")))
    middle = (F.col(f"p_{a}") + F.col(f"p_{b}")) / 2
    nmi = F.coalesce(F.try_divide(2 * F.col("mi"), F.col(f"h_{a}") + F.col(f"h_{b}")), F.lit(1.0))
    return row.select(F.col("n").cast("long").alias(COUNT), nmi.alias("nmi"), F.coalesce(F.try_divide(F.col("both") - expected, middle - expected), F.lit(1.0)).alias("ari"))


def _shared_information(x: float, y: float, n: float, step: int = 1 << 16) -> float:
    """The mean of k / n log(n k / (x y)) over the hypergeometric numbers k that groups of x and y out of n share: from the likeliest k outwards by ratios of neighbouring
    chances, until they are too small for a double; further ones would add exactly nothing."""
    low, high = max(0.0, x + y - n), min(x, y)
    middle = float(min(max(np.floor((x + 1) * (y + 1) / (n + 2)), low), high))
    term = lambda k: k / n * np.log(n * np.maximum(k, 1) / (x * y))
    weight, total = 1.0, float(term(np.array([middle]))[0])
    for up in (True, False):
        at, log = middle, 0.0
        while log > -750 and (at < high if up else at > low):
            if up:
                k = np.arange(at, min(at + step, high))
                logs, to = log + np.cumsum(np.log((x - k) / (k + 1)) + np.log((y - k) / (n - x - y + k + 1))), k + 1
            else:
                k = np.arange(at, max(at - step, low), -1.0)
                logs, to = log + np.cumsum(np.log(k / (x - k + 1)) + np.log((n - x - y + k) / (y - k + 1))), k - 1
            chance = np.exp(logs)
            weight, total, at, log = weight + float(chance.sum()), total + float((chance * term(to)).sum()), float(to[-1]), float(logs[-1])
    return total / weight


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> float:
    """AMI from the contingency table; its hypergeometric expectation is over the marginals, which must be few."""
    cells = df.groupBy(a, b).count().toPandas()  # a row for each pair of labels
    table = cells.pivot(index=a, columns=b, values="count").fillna(0).to_numpy(float)
    rows, cols, n = table.sum(1), table.sum(0), table.sum()
    entropy = lambda m: -(m[m > 0] / n * np.log(m[m > 0] / n)).sum()
    inside = table > 0
    mi = (table[inside] / n * np.log(n * table[inside] / np.outer(rows, cols)[inside])).sum()
    expected = sum(_shared_information(float(x), float(y), float(n)) for x in rows for y in cols)
    bottom = (entropy(rows) + entropy(cols)) / 2 - expected
    return float((mi - expected) / bottom) if abs(bottom) > 1e-15 else 1.0


def auc(df: DataFrame, score: str, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve as the Mann-Whitney statistic, ties halved; from counts by score."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    if keys:
        before = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("below", F.coalesce(F.sum("q").over(before), F.lit(0)))
    else:
        placed = running_total(counts, [score], "q", "below").withColumn("below", F.col("below") - F.col("q"))
    return placed.groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def accuracies(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Accuracy, balanced accuracy, and that of always naming the larger class."""
    right = F.avg((predicted == actual).cast("double"))
    of = lambda v: F.avg(F.when(actual == v, (predicted == v).cast("double")))
    share = F.avg(actual.cast("double"))
    return df.agg(F.count("*").alias(COUNT), right.alias("accuracy"), ((of(True) + of(False)) / 2).alias("balanced"), F.greatest(share, 1 - share).alias("majority"))


def regression_errors(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Mean absolute error and R2."""
    gap = F.col(actual).cast("double") - F.col(predicted).cast("double")
    return df.agg(F.count("*").alias(COUNT), F.avg(F.abs(gap)).alias("mae"), (1 - F.try_divide(F.sum(gap * gap), F.var_pop(F.col(actual).cast("double")) * F.count(actual))).alias("r2"))


def as_rows(df: DataFrame) -> DataFrame:
    """A one-row table as (metric, value) rows."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("m")).select("m.*")


def within_counts(df: DataFrame, keys: Sequence[str], distance: str, member: str, cutoffs: Sequence[float]) -> DataFrame:
    """Different members within each cutoff. One count by member first, so a member repeats at most once a key."""
    nearest = df.groupBy(*keys, member).agg(F.min(distance).alias("d"))
    return nearest.groupBy(*keys).agg(*[F.count_if(F.col("d") <= c).alias(f"within_{str(c).replace('.', 'p')}") for c in cutoffs])


def vector_profile(df: DataFrame, keys: Sequence[str], properties: Sequence[str]) -> DataFrame:
    """Mean, population deviation, least and greatest of each property."""
    out = []
    for p in properties:
        out += [F.avg(p).alias(f"{p}_mean"), F.stddev_pop(p).alias(f"{p}_sd"), F.min(p).alias(f"{p}_low"), F.max(p).alias(f"{p}_high")]
    return df.groupBy(*keys).agg(*out)


def shape_moments(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Centroid, population variances, sample covariances, skews, spans, and radius of gyration of points."""
    axes = (x, y, z)
    one = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("mean", F.avg), ("var", F.var_pop), ("skew", F.skewness))]
    two = [F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in ((x, y), (x, z), (y, z))]
    spans = [(F.max(a) - F.min(a)).alias(f"span_{a}") for a in axes]
    return df.groupBy(*keys).agg(F.count("*").alias(COUNT), *one, *two, *spans, F.sqrt(sum((F.var_pop(a) for a in axes), F.lit(0.0))).alias("gyration"))


def with_combined(df: DataFrame, key: str, name: str = "Combined") -> DataFrame:
    """The rows once under their own key and once under a common one."""
    return df.withColumn(key, F.explode(F.array(F.col(key), F.lit(name))))
