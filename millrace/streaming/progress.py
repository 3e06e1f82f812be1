"""Structured Streaming over crawl events: windowed progress, sessions, deduplication and per-domain spacing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """New Parquet files of a landing folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def progress(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by window and type; events later than the watermark are left out."""
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    out = grouped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    out = grouped.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_events(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def spaced(events: DataFrame, key: str, seconds: float = 1.0) -> DataFrame:
    """When each event of a key may start so that those of one key are ``seconds`` apart, with state per key."""

    def plan(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for t in rows["ts"].astype("int64") / 1e9:
            last = t if last is None else max(t, last + seconds)
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), "event_id": rows["event_id"].to_numpy(), "start_at": out})

    kind = dict(events.dtypes)[key]
    return events.select(key, "event_id", F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts")).groupBy(key).applyInPandasWithState(plan, f"{key} {kind}, event_id long, start_at double", "last double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that has landed, as a table in memory; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
