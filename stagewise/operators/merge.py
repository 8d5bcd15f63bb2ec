"""Messages merged into the state of their threads, in batch: windows and aggregates, so no thread is held whole.

A thread's messages are taken in order of (day, message_id). The first one opens it, with what it says, judged valid or not.
After that only valid messages move the status, and to what they say, but never back to Applied: so the status
after a message is the last one said up to it that is not Applied. A thread is valid once a message of it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def followed(messages: DataFrame) -> DataFrame:
    """messages (thread_id, message_id, day, is_valid, detected_status, ...) with n, the status after each, and that before."""
    w = Window.partitionBy("thread_id").orderBy("day", "message_id")
    df = messages.withColumns({"is_valid": F.coalesce("is_valid", F.lit(False)), "n": F.row_number().over(w)})
    said = F.when((F.col("is_valid") | (F.col("n") == 1)) & (F.col("detected_status") != "Applied"), F.col("detected_status"))
    df = df.withColumn("status", F.coalesce(F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("Applied")))
    valid_before = F.coalesce(F.max("is_valid").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return df.withColumns({"before": F.lag("status").over(w), "confirms": F.col("is_valid") & ~valid_before, "opened_on": F.min("day").over(Window.partitionBy("thread_id"))})


def threads(messages: DataFrame) -> DataFrame:
    """One row a thread: whether it is valid, its status, when it was opened and last moved, its latest subject, and the greatest confidence."""
    df = followed(messages)
    moved = F.when((F.col("n") == 1) | F.col("confirms") | (F.col("is_valid") & (F.col("status") != F.col("before"))), F.col("day"))
    return df.groupBy("thread_id").agg(
        F.max("is_valid").alias("is_valid"),
        F.max_by("status", "n").alias("current_status"),
        F.min("day").alias("application_date"),
        F.max(moved).alias("last_updated"),
        F.max_by("subject", "n").alias("latest_subject"),
        F.max("confidence").alias("parse_confidence"),
        F.count(F.lit(1)).alias("messages"),
    )


def status_events(messages: DataFrame) -> DataFrame:
    """(thread_id, message_id, from_status, to_status, occurred_on): the opening of valid threads, and each change of status."""
    df = followed(messages)
    opening = F.struct(F.lit(None).cast("string").alias("from_status"), F.lit("Applied").alias("to_status"), F.col("opened_on").alias("occurred_on"))
    change = F.struct(F.coalesce("before", F.lit("Applied")).alias("from_status"), F.col("status").alias("to_status"), F.col("day").alias("occurred_on"))
    moved = F.col("is_valid") & (F.col("status") != F.coalesce("before", F.lit("Applied")))
    made = F.filter(F.array(F.when(F.col("confirms"), opening), F.when(moved, change)), lambda e: e.isNotNull())
    return df.select("thread_id", "message_id", F.explode(made).alias("e")).select("thread_id", "message_id", "e.*")
