"""What the corpus operators share: input columns, written intermediate tables, Arrow batches."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.sources.shared import session_dir, shared_dir  # noqa: F401  both are part of this module


def quoted(name: str) -> str:
    """A column's whole name, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), a null text as the empty one; other columns, whatever their names, never get in the way."""
    return docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Folders of this session's written tables that are still there.
KEPT: set[str] = set()


def scratch(spark: SparkSession, kind: str = "tessera") -> str:
    """A new folder's name in the session's folder; tidy() removes it, and so does the end of the session's JVM."""
    path = f"{session_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    KEPT.add(path)
    return path


def place_of(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def removed(spark: SparkSession, path: str) -> None:
    store, at = place_of(spark, path)
    store.delete(at, True)
    KEPT.discard(path)


def tidy(spark: SparkSession) -> None:
    """Remove all intermediate tables of this session's corpus operators: for when no result is read any more."""
    for path in sorted(KEPT):
        removed(spark, path)
    store, at = place_of(spark, session_dir(spark))
    if not store.listStatus(at):
        store.delete(at, True)


#: Seconds between two collections by cleared(), and when the last one was.
CLEARED_EVERY = 10
CLEARED: dict[str, float] = {}


def cleared(spark: SparkSession) -> bool:
    """Let the driver's JVM collect its garbage between two steps, now and then, as Spark itself does every half hour: the shuffle files and broadcasts of what is done
    go, and the heap, which the plans of many short steps blow up, shrinks to what is in use. Whether it did."""
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - CLEARED.get(app, -CLEARED_EVERY) < CLEARED_EVERY:
        return False
    CLEARED[app] = now
    spark.sparkContext._jvm.System.gc()
    return True


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows of df as a table in the shared folder: lineage ends there, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    cleared(spark)
    return out


def dropped(df: DataFrame) -> None:
    """Remove a table made by written(), when nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        removed(df.sparkSession, path)


def plain(docs: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1 and so on, so that a helper column's name is never one of theirs."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def spot(docs: DataFrame, name: str) -> str:
    """The name that plain() gives a column."""
    return f"c{docs.columns.index(name)}"


def batches(rows: Iterable[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of one string column each; a single longer text is a slice of its own."""
    for batch in rows:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = lengths_of(column).cumsum()
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(ends.searchsorted(before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lengths_of(column: pa.Array):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("int64")
