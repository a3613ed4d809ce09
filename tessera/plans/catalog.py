"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "threshold_sweep"
PLACES = 6


class Tables:
    """The tables of a folder by name; a table's columns are read as a query needs them."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def rounded(x: Column) -> Column:
    """round(x, PLACES) as DuckDB has it: the scaled double goes to the nearest whole one, halves away from zero. Spark's own rounds the shortest decimal
    that names the double, so that 0.21056249999999999, whose millionfold is 210562.5, would go the other way."""
    near = F.round(x * 10.0**PLACES) / 10.0**PLACES
    return F.when(F.isnan(near) | (F.abs(near) == float("inf")), x).otherwise(near)


def register(name: str, sql: str | None = None, doubles: str = ""):
    """Enter a query of Tables under a name, with its SQL where there is one; doubles are rounded alike on either side, as sums depend on their order."""

    def enter(query: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = query(Tables(spark, sf_dir))
            return out.withColumns({c: rounded(F.col(c).cast("double")) for c in doubles.split()}) if doubles else out

        run.__doc__ = query.__doc__
        QUERIES[name] = run
        if sql:
            replaced = ", ".join(f"round(CAST({c} AS DOUBLE), {PLACES}) AS {c}" for c in doubles.split())
            ORACLE[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql}) AS made" if doubles else sql
        return query

    return enter


from tessera.plans import distributions, files, records, relations, sequences, series, structures, texts  # noqa: E402, F401  registration
