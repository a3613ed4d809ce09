"""Sorting, top-k, quotas, deduplication, set operations, and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.windows import running_total


# --- Filters ------------------------------------------------------------------------------------------------------


def all_of(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """Rows that meet every condition that is given; a null counts as not met."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions if c is not None], F.lit(True)))


def status_filter(df: DataFrame, status: str, refused: Sequence[str]) -> DataFrame:
    """Rows whose status, blank ones included, is not among the refused."""
    return df.where(~F.coalesce(F.lower(F.trim(status)), F.lit("")).isin(*[r.lower() for r in refused]))


def varying(df: DataFrame, columns: Sequence[str], least: float = 1e-8) -> list[str]:
    """The columns with a population variance above the least: one aggregation."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > least]


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in each of the columns; NaN is none."""
    return df.na.drop(subset=list(columns))


def first_scored(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate column with any finite value."""
    row = df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).alias(c) for c in candidates]).first()
    return next((c for c in candidates if row[c]), None)


def top_fraction(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """Rows at or above the value at place int(n * fraction) of the descending order; ties stay. The cut comes from counts by value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    placed = running_total(counts, [F.desc(value)], "c", "upto")
    placed = placed.crossJoin(F.broadcast(placed.agg(F.max("upto").alias("n"))))  # one row
    cut = placed.where(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("n") * fraction))).agg(F.max(value).alias("__cut"))
    return df.crossJoin(F.broadcast(cut)).where(F.col(value) >= F.col("__cut")).drop("__cut")  # one row


def searched(df: DataFrame, text: Sequence[str], query: str, facets: Mapping[str, object], order: Sequence[Column | str]) -> DataFrame:
    """Rows whose joined texts contain a query and whose facets match, sorted."""
    hit = F.contains(F.lower(F.concat_ws(" ", *text)), F.lit(query.lower()))
    return all_of(df, [hit, *[F.col(k) == v for k, v in facets.items()]]).orderBy(*order)


# --- Order and top-k -------------------------------------------------------------------------------------------------


def sorted_with_sentinels(df: DataFrame, keys: Sequence[tuple[str, bool, float]], tie: Sequence[str]) -> DataFrame:
    """Order by (column, descending, value for nulls)."""
    each = [F.coalesce(F.col(c), F.lit(s)) for c, _, s in keys]
    return df.orderBy(*[e.desc() if d else e.asc() for e, (_, d, _) in zip(each, keys, strict=True)], *tie)


def custom_order(column: str, values: Sequence[object]) -> Column:
    """A sort key: a value's place in a list, the rest after it."""
    return F.coalesce(F.create_map(*[x for k, v in enumerate(values) for x in (F.lit(v), F.lit(k))])[F.col(column)], F.lit(len(values)))


def top_by_group_max(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """All rows of the n groups with the largest maxima."""
    best = df.groupBy(group).agg(F.max(value).alias("__m")).orderBy(F.desc("__m"), group).limit(n).select(group)
    return df.join(best, group, "left_semi")


def quota_fill(df: DataFrame, preferred: Column, order: Sequence[Column | str], n: int) -> DataFrame:
    """n rows, preferred ones first, then others: a top-k, no full sort."""
    return df.withColumn("tier", F.when(preferred, 0).otherwise(1)).orderBy("tier", *order).limit(n)


def split_quota(df: DataFrame, first: Column, order: Sequence[Column | str], n: int, share: float = 0.6) -> DataFrame:
    """A share of n rows from the first kind, the rest from the other, either filling up what the other lacks."""
    head = int(n * share)
    top = lambda c: df.where(c).orderBy(*order).limit(n)
    two = top(first).withColumn("kind", F.lit(0)).unionByName(top(~F.coalesce(first, F.lit(False))).withColumn("kind", F.lit(1)))
    ranked = two.withColumn("__r", F.row_number().over(Window.partitionBy("kind").orderBy(*order)))
    late = F.when(F.col("kind") == 0, F.col("__r") > head).otherwise(F.col("__r") > n - head)
    return ranked.withColumn("__late", late.cast("int")).orderBy("__late", "kind", "__r").limit(n).drop("__r", "__late")


def cluster_quota(df: DataFrame, cluster: str, order: Sequence[Column | str], n: int, most: int = 10_000) -> DataFrame:
    """Rows by cluster in proportion to its size, at least 20 of those with 100 rows and 5 of those with 20 (fixed values); larger clusters choose first. Cluster sizes go to the driver; more than `most` clusters raise ValueError."""
    sizes = sorted(((r[cluster], r["count"]) for r in df.groupBy(cluster).count().limit(most + 1).collect()), key=lambda x: (-x[1], str(x[0])))
    if len(sizes) > most:
        raise ValueError("too many clusters for a quota")
    total, left, quota = sum(s for _, s in sizes), n, {}
    for c, s in sizes:
        want = max(round(n * s / total), 20 if s >= 100 else 5 if s >= 20 else 1)
        quota[c] = min(want, s, left)
        left -= quota[c]
    allowed = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]) if quota else None
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(cluster).orderBy(*order)))
    return ranked.where(F.col("__r") <= allowed[F.col(cluster)]).drop("__r") if quota else df.limit(0)


def round_robin(df: DataFrame, bin_: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """One of each bin in turn, until there are n."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(bin_).orderBy(*order))).where(F.col("turn") <= n).orderBy("turn", bin_).limit(n)


def greedy_chain(names: Sequence[object], distance: Mapping[tuple, float], start: object) -> list[object]:
    """An order in which each comes after its nearest predecessor left; over a small matrix."""
    out, left = [start], [x for x in names if x != start]
    while left:
        here = out[-1]
        nearest = min(left, key=lambda x: (distance.get((here, x), distance.get((x, here), float("inf"))), str(x)))
        out.append(nearest)
        left.remove(nearest)
    return out


# --- Deduplication ----------------------------------------------------------------------------------------------------


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key with the greatest order: an aggregation with map-side maxima."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m"))
    return best.select(*keys, *[F.col("m")[c].alias(c) for c in rest])


def entity_merge(df: DataFrame, key: str, status: str, ranks: Mapping[str, int], text: str, multi: str, first: str, order: str) -> DataFrame:
    """One row an entity: best status, longest text, all different parts of a delimited column, first non-blank value."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(status)], F.lit(len(ranks)))
    parts = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.transform(F.split(F.coalesce(multi, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")))))
    return df.groupBy(key).agg(
        F.min_by(status, F.struct(rank, F.col(order))).alias(status), F.max_by(text, F.struct(F.length(F.coalesce(text, F.lit(""))), -F.col(order))).alias(text), F.array_join(parts, ";").alias(multi),
        F.min_by(first, F.when(F.trim(first) != "", F.col(order))).alias(first), F.count("*").alias("merged"),
    )


def distinct_parts(c: Column) -> Column:
    """An array's members whose lower case has not come before, in order."""
    return F.filter(c, lambda x, i: (F.array_position(F.transform(c, F.lower), F.lower(x)) - 1) == i)


def dedup_reasons(df: DataFrame, key: str, row_id: str, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Every row with what speaks against it: the rules that hold, and the row that came first with its key."""
    first = F.first(row_id).over(Window.partitionBy(key).orderBy(row_id))
    texts = [F.when(F.col(row_id) != first, F.concat(F.lit("duplicate of "), first.cast("string"))), *[F.when(c, F.lit(t)) for c, t in rules]]
    why = F.concat_ws("; ", *texts)
    return df.withColumn("reason", why).withColumn("kept", F.col("reason") == "")


def filled(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Empty fields filled from the other table's row of the same key."""
    side = other.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = df.join(side, key, "left").withColumns({c: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"__{c}")) for c in columns})
    return out.drop(*[f"__{c}" for c in columns])


# --- Sets and shapes ------------------------------------------------------------------------------------------------------


def tagged_union(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in tables.items()])


def gaps(df: DataFrame, dims: Mapping[str, Sequence[object]]) -> DataFrame:
    """The wanted combinations that no row has; the wanted values are given lists."""
    wanted = df.sparkSession.range(1).select()
    for c, values in dims.items():
        wanted = wanted.withColumn(c, F.explode(F.array(*[F.lit(v) for v in values])))
    return wanted.join(df.select(*dims).distinct(), list(dims), "left_anti")


def pivoted(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[object], measures: Mapping[str, Column]) -> DataFrame:
    """Columns measure_value for given values: one aggregation, no pass to find the values."""
    aggs = [expr(F.col(column) == v).alias(f"{name}_{v}") for v in values for name, expr in measures.items()]
    return df.groupBy(*keys).agg(*aggs)


def first_where(c: str):
    return lambda condition: F.max(F.when(condition, F.col(c)))


def with_delta(df: DataFrame, names: Sequence[str], a: object, b: object) -> DataFrame:
    """name_delta = name_a - name_b where both are there."""
    return df.withColumns({f"{n}_delta": F.col(f"{n}_{a}") - F.col(f"{n}_{b}") for n in names if f"{n}_{a}" in df.columns and f"{n}_{b}" in df.columns})


def wide_matrix(df: DataFrame, key: str, name: str, values: Sequence[object], features: Mapping[str, float]) -> DataFrame:
    """Columns name__feature with a fill value by feature."""
    aggs = [F.coalesce(F.max(F.when(F.col(name) == v, F.col(f).cast("double"))), F.lit(float(fill))).alias(f"{v}__{f}") for v in values for f, fill in features.items()]
    return df.groupBy(key).agg(*aggs)


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renamed columns; raises where two would have one name."""
    out = [names.get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise ValueError(f"duplicate column names: {sorted({c for c in out if out.count(c) > 1})}")
    return df.toDF(*out)


def dense_matrix(pairs: DataFrame, key: str, value: str, names: Sequence[object], diagonal: float) -> DataFrame:
    """A symmetric matrix as rows, from pairs key_a < key_b."""
    both = pairs.select(F.col(f"{key}_a").alias("row"), F.col(f"{key}_b").alias("col"), value).union(pairs.select(F.col(f"{key}_b"), F.col(f"{key}_a"), value))
    table = both.groupBy("row").agg(*[F.max(F.when(F.col("col") == n, F.col(value))).alias(str(n)) for n in names])
    return table.withColumns({str(n): F.when(F.col("row") == n, F.lit(diagonal)).otherwise(F.col(str(n))) for n in names})
