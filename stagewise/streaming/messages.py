"""Streams of messages: at-least-once delivery made once, weekly counts, and a keyed fold with time-outs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..domain import GHOST_AFTER


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream; a naive time is taken in the session's zone."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, key: str = "event_id", overlap: str = "2 days") -> DataFrame:
    """Each event once, although the last `overlap` is read again."""
    return events.withWatermark("ts", overlap).dropDuplicatesWithinWatermark([key])


def weekly(events: DataFrame, *by: str, late: str = "2 days") -> DataFrame:
    """Counts by week, Monday first. The epoch fell on a Thursday, so weeks are moved by four days."""
    marked = events if events.isStreaming is False else events.withWatermark("ts", late)
    week = F.window("ts", "7 days", startTime="4 days")
    return marked.groupBy(week, *by).agg(F.count(F.lit(1)).alias("events")).select(F.to_date("window.start").alias("week_start"), *by, "events")


STATE = "status string, last timestamp, events long"
OUT = "key long, status string, last timestamp, events long, ghosted boolean"


def fold_status(events: DataFrame, days: int = GHOST_AFTER) -> DataFrame:
    """The status of each key of (key, ts, status): that of its latest event; "Ghosted" once none came for `days` in event time.

    An event older than the latest never rolls the status back; one that comes after a time-out revives the key, with a
    new count. Then it is newer than the watermark, and so than all before: Spark drops what is older than the watermark.
    State is one row a key until its time-out, and the events of one micro-batch are read in chunks, so no key is held whole.
    """
    limit = pd.Timedelta(days=days)

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, last, n = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "status": ["Ghosted"], "last": [pd.Timestamp(last) + limit], "events": [n], "ghosted": [True]})
            return
        status, last, n = state.get if state.exists else (None, None, 0)
        last = pd.Timestamp(last) if last is not None else None
        for chunk in chunks:
            n += len(chunk)
            newest = chunk.sort_values(["ts", "status"]).iloc[-1]
            if last is None or newest["ts"] >= last:
                status, last = newest["status"], newest["ts"]
        state.update((status, last.to_pydatetime(), n))
        # a time-out may not lie behind the watermark
        due = max(int((last + limit).timestamp() * 1000), state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"key": [key[0]], "status": [status], "last": [last], "events": [n], "ghosted": [False]})

    return events.groupBy("key").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
