"""The writing side as streams: every batch may come again and changes nothing the second time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from regesta.operators.upserts import latest


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, keys: list[str], version: list[str]) -> StreamingQuery:
    """Keep a snapshot of the latest row per key. A batch reads the newest snapshot before its own, folds itself in and writes the snapshot of its number, so a
    batch that is run again writes the same one; a reader takes the highest number (read_snapshot)."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in snapshot_numbers(spark, target) if n < number]
        known = spark.read.parquet(f"{target}/{max(before):020d}") if before else None
        rows = batch if known is None else known.unionByName(batch)
        latest(rows, keys, version).write.mode("overwrite").parquet(f"{target}/{number:020d}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_numbers(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the snapshots that were written whole."""
    if not _exists(spark, target):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(int(n) for n in names if n.isdigit() and _exists(spark, f"{target}/{n}/_SUCCESS"))


def read_snapshot(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{max(snapshot_numbers(spark, target)):020d}")


def once_per_period(stream: DataFrame, key: str, at: str, period: str) -> DataFrame:
    """The first event of each key and period (for date_trunc: 'day', 'month'); keys are kept no longer than a period after the watermark."""
    lateness = {"day": "1 day", "month": "31 days", "hour": "1 hour"}[period]
    return stream.withWatermark(at, lateness).withColumn("periode", F.date_trunc(period, at)).dropDuplicatesWithinWatermark([key, "periode"])


def counted_stream(stream: DataFrame, by: list[str], at: str, window: str, lateness: str) -> DataFrame:
    """Events per window and key, final once the watermark has passed the window."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, window), *by).agg(F.count("*").alias("n"))


LEASES = "id long, state string, attempts int, lease_until double"


def lease_states(stream: DataFrame, lease_seconds: float) -> DataFrame:
    """The state of each job after its events. stream: id, at (seconds), event (take, complete, skip, fail), max_attempts.

    A job is taken when it waits or its lease has run out; every take is an attempt; a failure after the last attempt is final. An event that
    does not fit the state changes nothing, so events delivered twice do no harm.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, attempts, until = state.get if state.exists else ("pending", 0, 0.0)
        for b in batches:
            for at, event, most in b.sort_values("at")[["at", "event", "max_attempts"]].itertuples(index=False):
                if event == "take" and (name == "pending" or (name == "leased" and at >= until)):
                    name, attempts, until = "leased", attempts + 1, at + lease_seconds
                elif name == "leased" and event in ("complete", "skip"):
                    name = {"complete": "done", "skip": "skipped"}[event]
                elif name == "leased" and event == "fail":
                    name = "dead" if attempts >= most else "pending"
        state.update((name, attempts, until))
        yield pd.DataFrame({"id": [key[0]], "state": [name], "attempts": [attempts], "lease_until": [until]})

    return stream.groupBy("id").applyInPandasWithState(step, LEASES, "state string, attempts int, lease_until double", "update", GroupStateTimeout.NoTimeout)
