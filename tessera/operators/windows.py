"""Order-aware operators: rolling and running values, ranks, blocks, streaks, state machines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import columns as C
from tessera.sources.shared import settled


def rolling_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, name: str = "rolling") -> DataFrame:
    """Median of a centred frame of so many rows, shorter at the ends."""
    half = width // 2
    return df.withColumn(name, F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)))


def velocities(df: DataFrame, keys: Sequence[str], time: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Rate and middle time of each interval with a positive length, numbered from 0 among all of the key's intervals."""
    w = Window.partitionBy(*keys).orderBy(time, *tie)
    each = df.select(*keys, F.col(time).alias("t"), F.lead(time).over(w).alias("t2"), F.col(value).alias("v"), F.lead(value).over(w).alias("v2"), (F.row_number().over(w) - 1).alias("interval"))
    return each.where("t2 > t").select(*keys, "interval", ((F.col("t") + F.col("t2")) / 2).alias("middle"), ((F.col("v2") - F.col("v")) / (F.col("t2") - F.col("t"))).alias("velocity"))


def velocity_summary(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    v = F.col("velocity")
    return rates.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_samp(v).alias("sd"), F.avg((v < 0).cast("double")).alias("falling"),
        F.avg((v > 0).cast("double")).alias("rising"), F.percentile(v, F.lit(0.05)).alias("p05"), F.percentile(v, F.lit(0.95)).alias("p95"),
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "nth", start: int = 0) -> DataFrame:
    """Place within the key from start on."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start)


def _ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows sorted in ranges and written once, with their range and their place in it."""
    rows = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    return rows.withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})


def _added(rows: DataFrame, amount: Column) -> DataFrame:
    """What the ranges before each range hold; a row for each range."""
    each = rows.groupBy("__range").agg(F.sum(amount).alias("__own"))
    return each.withColumn("__before", F.coalesce(F.sum("__own").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__own")


def placed(df: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Each row's place from 0 on in the order of the whole table, without a window over it: ranges are sorted side by side and only their sizes are added up in one
    place. Rows that the order can't tell apart stand in one range: name enough columns."""
    rows = _ranges(df, order)
    return rows.join(F.broadcast(_added(rows, F.lit(1))), "__range").withColumn(name, F.col("__at") + F.col("__before")).drop("__range", "__at", "__before")


def running_total(df: DataFrame, order: Sequence[Column | str], amount: str, name: str) -> DataFrame:
    """The sum of an amount up to each row in the order of the whole table, range by range."""
    rows = _ranges(df, order)
    upto = F.sum(amount).over(Window.partitionBy("__range").orderBy("__at"))
    return rows.withColumn(name, upto).join(F.broadcast(_added(rows, F.col(amount))), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__at", "__before")


def beside(df: DataFrame, order: Sequence[Column | str], back: int = 0, ahead: int = 0, block_rows: int = 1 << 17) -> DataFrame:
    """The rows of one long series in blocks by place, each with so many rows before and after it from its neighbours: a window by __block sees what one over
    the whole series would. __own marks a block's own rows, __place is the place from 0 on. Blocks are no shorter than what they borrow."""
    size = max(block_rows, back, ahead, 1)
    rows = placed(df, order, "__place")
    at, block = F.col("__place") % size, F.floor(F.col("__place") / size)
    near = F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.when(at < ahead, F.struct((block - 1).alias("b"), F.lit(False).alias("own"))), F.when(at >= size - back, F.struct((block + 1).alias("b"), F.lit(False).alias("own"))))
    each = rows.withColumn("__near", F.explode(F.array_compact(near)))
    return each.select(*rows.columns, F.col("__near.b").alias("__block"), F.col("__near.own").alias("__own")).where("__block >= 0")


def long_rolling_median(df: DataFrame, order: Sequence[Column | str], value: str, width: int, name: str = "rolling", block_rows: int = 1 << 17) -> DataFrame:
    """rolling_median() of one series of any length."""
    half = width // 2
    frame = Window.partitionBy("__block").orderBy("__place").rowsBetween(-half, half)
    rows = beside(df, order, half, half, block_rows).withColumn(name, F.percentile(value, F.lit(0.5)).over(frame))
    return rows.where("__own").drop("__block", "__own", "__place")


def long_velocities(df: DataFrame, time: str, value: str, tie: Sequence[str] = (), block_rows: int = 1 << 17) -> DataFrame:
    """velocities() of one series of any length."""
    w = Window.partitionBy("__block").orderBy("__place")
    rows = beside(df.select(time, value, *tie), [time, *tie], 0, 1, block_rows)
    each = rows.select("__own", F.col(time).alias("t"), F.lead(time).over(w).alias("t2"), F.col(value).alias("v"), F.lead(value).over(w).alias("v2"), F.col("__place").alias("interval"))
    return each.where("__own AND t2 > t").select("interval", ((F.col("t") + F.col("t2")) / 2).alias("middle"), ((F.col("v2") - F.col("v")) / (F.col("t2") - F.col("t"))).alias("velocity"))


def long_closing_rises(df: DataFrame, order: Sequence[str], value: str, block_rows: int = 1 << 17) -> DataFrame:
    """closing_rises() of one series of any length: what counts is the last place that is no rise."""
    w = Window.partitionBy("__block").orderBy("__place")
    up = F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(False))
    rows = beside(df.select(*dict.fromkeys([*order, value])), order, 1, 0, block_rows).select("__own", "__place", up.alias("up")).where("__own")
    return rows.agg((F.count("*") - F.coalesce(F.max(F.when(~F.col("up"), F.col("__place") + 1)), F.lit(0))).alias("rises"))


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "percentile") -> DataFrame:
    """Per cent of the key's rows at or below the value; nulls come first. Without keys, from counts by value."""
    if keys:
        return df.withColumn(name, 100 * F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)))
    counts = running_total(df.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__c")), ["__v"], "__c", "__upto")
    shares = counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("__all")))).select("__v", (100 * (F.col("__upto") / F.col("__all"))).alias(name))  # one row
    return df.join(shares, F.col(value).eqNullSafe(F.col("__v")), "left").drop("__v")


def heads(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str = "block") -> DataFrame:
    """Contiguous blocks of like sizes, the first ones a row larger; numbered from 0."""
    if keys:
        return df.withColumn(name, F.ntile(n).over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    rows = placed(df, order, "__place")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("__all"))))  # one row, counted on the written rows
    small, large = F.floor(F.col("__all") / n), F.col("__all") % n
    first = large * (small + 1)
    at = F.col("__place")
    block = F.when(at < first, F.floor(at / (small + 1))).otherwise(large + F.floor(F.try_divide(at - first, small)))
    return rows.withColumn(name, block.cast("int")).drop("__place", "__all")


def quantile_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str = "block") -> DataFrame:
    """Blocks of positions cut at linear quantiles, right-closed, as quantile binning of a row number does."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"__p": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    return ranked.withColumn(name, F.greatest(F.lit(0), F.ceil(F.try_divide(F.col("__p") * n, F.col("__n") - 1)) - 1).cast("int")).drop("__p", "__n")


def block_shares(df: DataFrame, state: str, block: str) -> DataFrame:
    """Each state's share of each block."""
    counts = df.groupBy(block, state).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(block)))


def tail(df: DataFrame, keys: Sequence[str], time: str, span: float) -> DataFrame:
    """The rows within a span of the key's last time."""
    return df.withColumn("__last", F.max(time).over(Window.partitionBy(*keys))).where(F.col(time) >= F.col("__last") - span).drop("__last")


def closing_rises(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """How many rises in a row a key's series ends with."""
    w = Window.partitionBy(*keys).orderBy(*order)
    each = df.select(*keys, F.row_number().over(w).alias("r"), (F.col(value) > F.lag(value).over(w)).alias("up"))
    last = each.groupBy(*keys).agg(F.max("r").alias("n"), F.coalesce(F.max(F.when(~F.coalesce("up", F.lit(False)), F.col("r"))), F.lit(0)).alias("broken"))
    return last.select(*keys, (F.col("n") - F.col("broken")).alias("rises"))


def run_verdict(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, recent: int = 8) -> DataFrame:
    """Rise of the last value from the first and from the best, and the range of the last few."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"__r": F.row_number().over(w.orderBy(*order)), "__n": F.count("*").over(w)})
    late = F.when(F.col("__r") > F.col("__n") - recent, F.col(value))
    last = F.max_by(value, "__r")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), (last - F.min_by(value, "__r")).alias("from_first"), (last - F.min(value)).alias("from_best"), (F.max(late) - F.min(late)).alias("recent_range"))


def converged_at(df: DataFrame, keys: Sequence[str], order: str, value: str, least: float = 0.05, patience: int = 2) -> DataFrame:
    """The first place at which the relative fall of a value has been below `least` for `patience` steps in a row; null where it never is."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    small = F.coalesce(F.try_divide(before - F.col(value), F.greatest(F.abs(before), F.lit(1e-12))) < least, F.lit(False))
    each = df.select(*keys, F.col(order).alias("at"), small.alias("small"))
    w2 = Window.partitionBy(*keys).orderBy("at")
    streak = F.sum(F.col("small").cast("int")).over(w2.rowsBetween(1 - patience, 0))
    return each.withColumn("streak", streak).groupBy(*keys).agg(F.min(F.when(F.col("streak") >= patience, F.col("at"))).alias("converged"))


def relabelled(groups: DataFrame, order: Sequence[Column], first: Column | None = None, prefix: str = "Group ") -> DataFrame:
    """A table of few groups with labels by rank; those that meet `first` lead."""
    lead = [first.desc()] if first is not None else []
    return groups.withColumn("label", F.concat(F.lit(prefix), F.row_number().over(Window.orderBy(*lead, *order)).cast("string")))


def normal_scores(df: DataFrame, keys: Sequence[str], value: str, name: str = "score", lower_is_better: bool = False) -> DataFrame:
    """The normal distribution function of each value's population z-score; a half where values do not differ."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(name, F.when(sd < 1e-9, F.lit(0.5)).otherwise(C.normal_score(F.try_divide(F.col(value) - F.avg(value).over(w), sd), lower_is_better)))


def robust_scaled(df: DataFrame, value: str, name: str = "scaled", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Values between two nearest-rank percentiles of the whole column, held to [0, 1]; the two bounds are one broadcast row."""
    from tessera.operators.aggregates import ranked_quantile

    lo, hi = (ranked_quantile(df, value, p).withColumnRenamed("quantile", n) for p, n in ((low, "__lo"), (high, "__hi")))
    return df.crossJoin(F.broadcast(lo.crossJoin(hi))).withColumn(name, C.robust(F.col(value), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def unique_ids(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Repeats of a name get _dup2, _dup3 and so on."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("unique_id", F.when(nth == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_dup"), nth.cast("string"))))


def next_ids(ledger: DataFrame, new: DataFrame, column: str, order: Sequence[str], prefix: str = "S", width: int = 6) -> DataFrame:
    """New rows with ids that go on from a ledger's largest number, in order."""
    top = ledger.agg(F.coalesce(F.max(F.regexp_extract(column, rf"^{prefix}(\d+)$", 1).try_cast("long")), F.lit(0)).alias("__top"))
    at = F.col("__place") + 1 + F.col("__top")
    return placed(new, order, "__place").crossJoin(F.broadcast(top)).withColumn(column, F.concat(F.lit(prefix), F.lpad(at.cast("string"), width, "0"))).drop("__top", "__place")  # one row


def grouped_by_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, name: str = "group") -> DataFrame:
    """How many flagged rows a row and those before it have: each flag opens a group."""
    return df.withColumn(name, F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(Window.partitionBy(*keys).orderBy(*order)))


def marked_slice(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Column, end: Column) -> DataFrame:
    """The rows from the first start marker to the first end marker after it, both included."""
    w = Window.partitionBy(*keys).orderBy(*order)
    begun = df.withColumn("__in", F.max(start.cast("int")).over(w)).where("__in = 1")
    over = F.coalesce(F.max(end.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return begun.withColumn("__over", over).where("__over = 0").drop("__in", "__over")


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], stride: int) -> DataFrame:
    """Rows 0, stride, 2 stride and so on of each key."""
    return numbered(df, keys, order, "__p").where(F.col("__p") % stride == 0).drop("__p")
