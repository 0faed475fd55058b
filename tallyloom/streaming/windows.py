"""Event-time operators that run the same on a batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shared import new_path

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 64) -> DataFrame:
    """The events table as a stream; it may be one file or a folder of files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    one = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    r = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger)
    return r.option("pathGlobFilter", "events.parquet").parquet(folder) if one else r.parquet(f"{folder}/events.parquet")


def run_available(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Runs a stream over what is there and reads its result back from the shared folder.

    Results are appended by a file sink, which commits each batch once. Windows come out when the watermark has passed
    their end, and their state goes. With ``at``, a folder that keeps result and progress, a later run goes on where the
    one before ended, or was broken off.
    """
    spark = stream.sparkSession
    at = at or new_path(spark, name)
    w = stream.writeStream.outputMode("append").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True)
    w.format("parquet").option("path", f"{at}/result").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/result")


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """window_start, event_type, n, total of each tumbling window."""
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    w = F.window("ts", width, step)
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, session_start, n: runs of events of a user without a pause of ``gap``."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def over_rate(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Events that have ``limit`` or more events of the same user in the ``seconds`` before them, themselves included."""
    w = W.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count("*").over(w)).where(F.col("recent") >= limit)


def changes_batch(events: DataFrame) -> DataFrame:
    """Events whose type differs from that of the user's event before: event_id, user_id, event_type."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("event_type").over(w)
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("event_type"))).select("event_id", "user_id", "event_type")


def changes_stream(events: DataFrame, forget: str | None = None) -> DataFrame:
    """``changes_batch`` on a stream: the state of a user is the type last seen.

    With ``forget`` a user's state goes when the watermark is that far beyond the user's last event (the next one counts as a
    change then), so users who never come back don't pile up; events must have a watermark.
    """
    wait = int(pd.Timedelta(forget).total_seconds() * 1000) if forget else 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, until = state.get if state.exists else (None, 0)
        own = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = own["event_type"].shift(1)
        before.iloc[0] = last
        until = max(until, int(own["ts"].max().timestamp() * 1000) + wait)
        state.update((own["event_type"].iloc[-1], until))
        if forget:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield own.loc[before.isna() | (before != own["event_type"]), ["event_id", "user_id", "event_type"]]

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, event_type string", "last string, until long", "append", "EventTimeTimeout" if forget else "NoTimeout")


def first_in_time(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Drops repeats of the keys that come within ``delay`` of each other (on a stream), or all repeats (on a batch)."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def complete_groups(events: DataFrame, key: str, kind: str, wanted: list[str]) -> DataFrame:
    """Keys for which every wanted kind has come, and when the last of them first came."""
    d = events.where(F.col(kind).isin(*wanted)).groupBy(key, kind).agg(F.min("ts").alias("t"))
    return d.groupBy(key).agg(F.count("*").alias("n"), F.max("t").alias("ready_at")).where(F.col("n") == len(wanted)).drop("n")
