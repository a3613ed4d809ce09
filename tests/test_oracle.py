"""Every table query with SQL against DuckDB on the smallest tables; queries without SQL must run and give rows."""

import decimal
import math
import os

import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def normal(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(normal, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_duckdb(spark, duck, name):
    made = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(made.columns)
    ours = sorted((tuple(normal(r[c]) for c in columns) for r in made.collect()), key=repr)
    cursor = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_doubles_are_rounded_as_duckdb_does(spark):
    """Scaled halves, where the shortest decimal of a double lies on the other side."""
    import duckdb

    x = [88.15, 222.91, (222.91 - 88.15) / 640, 0.0000005, -0.0000005, 1.0000005, -2.5000005, 0.4999995, 1e308, -1e300, 123456789012.1234565, 0.0, float("inf"), float("-inf"), float("nan"), None]
    x += [sign * (k + 0.5) / 1e6 * m for k in range(0, 4000, 7) for m in (1, 1 - 2**-53, 1 + 2**-52) for sign in (1, -1)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double")
    ours = [r.y for r in df.select("k", catalog.rounded(F.col("x")).alias("y")).orderBy("k").collect()]
    theirs = [duckdb.execute(f"SELECT round(?::DOUBLE, {catalog.PLACES})", [v]).fetchone()[0] for v in x]
    assert [repr(None if v is None else v + 0.0) for v in ours] == [repr(None if v is None else v + 0.0) for v in theirs]


def test_velocity_on_a_scaled_half(spark, tmp_path):
    """640 seconds from 88.15 to 222.91, whose rate was rounded down here and up there."""
    import duckdb

    duckdb.execute(f"""COPY (SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-05 11:19:55' + to_seconds(640 * i) AS ts, 1::BIGINT AS user_id, [88.15, 222.91, 3.0][i + 1]::DOUBLE AS value FROM range(3) t(i))
        TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(catalog.ORACLE["long_velocities"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["long_velocities"](spark, str(tmp_path)).collect())) == sorted(want) and want[0][2] == 0.210563
