"""The same functions for SQL: temporary functions of a session. Expression ones are SQL functions, which Spark inlines; alignment is a vectorized Python function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F

SQL = {
    "clamp01(x DOUBLE) RETURNS DOUBLE": "greatest(0D, least(1D, nanvl(coalesce(x, 0D), 0D)))",
    "set_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)",
    "cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN sqrt(vector_dot(a, a)) <= 1e-12 OR sqrt(vector_dot(b, b)) <= 1e-12 THEN 1D ELSE 1 - vector_dot(a, b) / (sqrt(vector_dot(a, a)) * sqrt(vector_dot(b, b))) END",
    "circular_delta(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "pmod(a - b + 180D, 360D) - 180D",
    "robust_scale(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE": "CASE WHEN x IS NULL OR low IS NULL OR high IS NULL OR abs(high - low) < 1e-12 THEN 0.5D ELSE greatest(0D, least(1D, try_divide(x - low, high - low))) END",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; their names."""
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("double")
    def alignment_identity(a: pd.Series, b: pd.Series) -> pd.Series:
        from tessera.operators.kernels import align

        made = [align(x or "", y or "") for x, y in zip(a, b, strict=True)]
        return pd.Series([same / n if n else None for _, same, n in made], dtype="float64")

    spark.udf.register("alignment_identity", alignment_identity)
    return [head.split("(")[0] for head in SQL] + ["alignment_identity"]
