"""Incremental work: processed-key ledgers, windows over event time, and a running guard of series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unprocessed(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key the ledger does not have."""
    return rows.join(ledger.select(key).distinct(), key, "left_anti")


def resuming(stream: DataFrame, ledger_path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """A stream writer that does the work for keys that the ledger lacks, and enters them; a batch that is run again enters nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            new = unprocessed(df, spark.read.parquet(ledger_path), key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            new = df
        work(new.dropDuplicates([key])).write.mode("append").parquet(ledger_path)

    return stream.writeStream.foreachBatch(batch)


def windowed(df: DataFrame, time: str, width: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Count, sum and mean by tumbling window, of a stream (with a watermark) or of a table."""
    rows = df.withWatermark(time, late) if late else df
    out = rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions of events with no longer pause than the gap."""
    rows = df.withWatermark(time, late) if late else df
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_seen(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def guarded(stream: DataFrame, key: str, value: str, rise: float) -> DataFrame:
    """(key, n, best, last, verdict) as values come in: 'cliff' once the last value is over the best by the rise."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, best, last = state.get if state.exists else (0, float("inf"), float("nan"))
        for pdf in batches:
            for v in pdf[value]:
                n, best, last = n + 1, min(best, v), v
        state.update((n, best, last))
        yield pd.DataFrame([(k[0], n, best, last, "cliff" if last - best > rise else "watching")], columns=["key", "n", "best", "last", "verdict"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"key {kind}, n long, best double, last double, verdict string", "n long, best double, last double", "update", GroupStateTimeout.NoTimeout)


class _Guard(StatefulProcessor):
    """Readings of a key wait until the watermark has passed their time, and are then judged in order of it."""

    def __init__(self, time: str, value: str, rise: float, idle_ms: int):
        self.time, self.value, self.rise, self.idle = time, value, rise, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, v double")
        self.seen = handle.getValueState("seen", "n long, best double, at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        fresh = []
        for pdf in rows:
            known = pdf[pdf[self.value].notna() & pdf[self.time].notna()]
            fresh += list(zip(known[self.time].astype("datetime64[us]").astype("int64").tolist(), known[self.value].astype(float).tolist(), strict=True))
        if fresh:
            self.waiting.appendList(fresh)
            for at in {-(-t // 1000) for t, _ in fresh}:
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(tuple(x) for x in self.waiting.get())
        due = [x for x in held if -(-x[0] // 1000) <= now]
        n, best, at = self.seen.get() if self.seen.exists() else (0, float("inf"), 0)
        out = []
        for t, v in due:
            n, best, at = n + 1, min(best, v), t
            out.append((key[0], t, n, best, v, "cliff" if v - best > self.rise else "watching"))
        if due:
            if len(due) < len(held):
                self.waiting.put(held[len(due) :])
            else:
                self.waiting.clear()
            self.seen.update((n, best, at))
            self.handle.registerTimer(at // 1000 + self.idle)
        elif n and not held and now >= at // 1000 + self.idle:
            self.seen.clear()
            out.append((key[0], at, n, best, float("nan"), "ended"))
        if out:
            rows = pd.DataFrame(out, columns=["key", "at", "n", "best", "last", "verdict"])
            yield rows.assign(at=pd.to_datetime(rows["at"], unit="us"))

    def close(self) -> None:
        pass


def guarded_by_time(stream: DataFrame, key: str, time: str, value: str, rise: float, late: str, idle: str) -> DataFrame:
    """(key, at, n, best, last, verdict) of each reading in order of its own time, whatever the order of arrival within `late`: 'cliff' where a value is over the best so far by the rise.

    A key without readings for `idle` is reported once as 'ended' and forgotten, so that the state holds only the keys that are alive.
    Readings without a time or value count for none. Needs a state store with timers (RocksDB), and a stream.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = stream.select(key, time, value).withWatermark(time, late)
    kind = dict(stream.dtypes)[key]
    schema = f"key {kind}, at timestamp, n long, best double, last double, verdict string"
    return rows.groupBy(key).transformWithStateInPandas(_Guard(time, value, rise, idle_ms), schema, "Update", "EventTime")


def guard_table(df: DataFrame, key: str, time: str, value: str, rise: float) -> DataFrame:
    """The readings of guarded_by_time() of a table, less the ends."""
    rows = df.where(F.col(time).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    w = Window.partitionBy(key).orderBy(time, value).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select(F.col(key).alias("key"), F.col(time).alias("at"), F.count("*").over(w).alias("n"), F.min(value).over(w).alias("best"), F.col(value).cast("double").alias("last"))
    return out.withColumn("verdict", F.when(F.col("last") - F.col("best") > rise, "cliff").otherwise("watching"))
