"""Edits, migration, repair and review over the driver's tables: which rows they concern follows from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edits, review, upkeep
from .build import Frames

EDITED_ON = "2001-08-01"
#: Whole units of cost, of a month's budget, and calls of one run.
BUDGET, CAP = 9_000, 400
STORED = ["is_valid", "detected_status", "job_type", "industry"]


def rest(n: int):
    return F.col("thread_id").cast("long") % n


def changed(before: DataFrame, after: DataFrame, *columns: str) -> DataFrame:
    """The rows whose columns are no longer what they were."""
    old = before.select(F.col("thread_id").alias("old__"), *(F.col(c).alias(f"old__{c}") for c in columns))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old__{c}"))
    return after.join(old, F.col("thread_id") == F.col("old__")).where(differs).select("thread_id", *columns)


def status_edits(f: Frames) -> DataFrame:
    apps = f["raw_applications"]
    status = F.when(rest(3) == 0, "Offer").when(rest(3) == 1, "Screening/OA").otherwise("Applied")
    return apps.where(rest(5) == 0).select("thread_id", status.alias("status"), F.lit(f"{EDITED_ON}T08:00").alias("day"), F.lit("by hand").alias("note"))


def edit_status(f: Frames) -> DataFrame:
    apps = f["raw_applications"]
    return changed(apps, edits.set_status(apps, status_edits(f))[0], "current_status", "last_updated", "application_date")


def edit_status_events(f: Frames) -> DataFrame:
    return edits.set_status(f["raw_applications"], status_edits(f))[1]


def valid_edits(f: Frames) -> DataFrame:
    apps = f["raw_applications"]
    return apps.where(rest(7) == 0).select("thread_id", (rest(2) == 0).alias("valid"), F.when(rest(3) == 0, "").when(rest(3) == 1, "seen").otherwise("manual: sure").alias("reason"))


def edit_valid(f: Frames) -> DataFrame:
    apps = f["raw_applications"]
    return edits.set_valid(apps, f["raw_events"], valid_edits(f))[0].where(rest(7) == 0).select("thread_id", "is_valid", "filter_reason")


def edit_valid_events(f: Frames) -> DataFrame:
    """Threads whose number is divisible by nine are taken to have no events."""
    return edits.set_valid(f["raw_applications"], f["raw_events"].where(rest(9) != 0), valid_edits(f))[1].drop("occurred_on")


def edit_fields(f: Frames) -> DataFrame:
    apps = f["raw_applications"]
    given = apps.where(rest(6) == 1).select("thread_id", F.concat(F.lit("  Data Analyst "), rest(4).cast("string")).alias("role_title"), F.when(rest(4) == 3, "Ipoh").alias("location"))
    return changed(apps, edits.update_fields(apps, given), "role_title", "role_family", "location")


def edit_follow_up(f: Frames) -> DataFrame:
    apps = f["raw_applications"]
    given = apps.where(rest(10) == 3).select("thread_id", F.lit(EDITED_ON).alias("day"), F.when(rest(4) == 3, " called ").alias("note"))
    return changed(apps, edits.followed_up(apps, given), "notes", "last_updated")


def lost(f: Frames) -> tuple[DataFrame, DataFrame]:
    """(events, history) of an older store: some threads' events are only in its history, and some nowhere."""
    events = f["raw_events"]
    history = events.where(rest(8) == 0).select("thread_id", "from_status", "to_status", F.col("recorded_at").alias("changed_at"), "note")
    return events.where(~rest(8).isin(0, 4)), history


def migration_events(f: Frames) -> DataFrame:
    apps = upkeep.renamed_statuses(f["raw_applications"])
    return upkeep.missing_events(apps, *lost(f)).select("thread_id", "from_status", "to_status", "occurred_on", "source", "note")


def migration_again(f: Frames) -> DataFrame:
    """How many events each source has after one and after two migrations."""
    apps, events = upkeep.migrated(f["raw_applications"], *lost(f))
    again = upkeep.migrated(apps, events, lost(f)[1])[1]
    both = events.select("source", F.lit(1).alias("once"), F.lit(0).alias("twice")).unionByName(again.select("source", F.lit(0).alias("once"), F.lit(1).alias("twice")))
    return both.groupBy("source").agg(F.sum("once").alias("once"), F.sum("twice").alias("twice"))


def stored(read: DataFrame, events: tuple[str, ...]) -> DataFrame:
    """What an older reader has stored of messages; those looked at by hand are not to be repaired."""
    real = F.col("truth").isin(*events)
    return read.where(F.col("k") % 11 != 0).select("message_id", real.alias("is_valid"), F.when(real, F.col("truth")).alias("detected_status"), F.lit("Full-Time").alias("job_type"), F.when(F.col("k") % 3 == 0, "").otherwise(F.col("industry")).alias("industry"))


def recomputed(read: DataFrame) -> DataFrame:
    return read.select("message_id", F.col("verdict.is_valid").alias("is_valid"), "detected_status", "job_type", "industry")


def repairs(read: DataFrame, events: tuple[str, ...]) -> DataFrame:
    return upkeep.repair_plan(stored(read, events), recomputed(read), "message_id", STORED)


def repaired_rows(read: DataFrame, events: tuple[str, ...]) -> DataFrame:
    return upkeep.repaired(stored(read, events), repairs(read, events), "message_id")


def doubtful(read: DataFrame) -> DataFrame:
    """Messages (with chars, the length of the snippet) that the rules are not sure of, and some others."""
    unsure = read.where("is_ambiguous OR k % 4 = 0")
    return unsure.select("message_id", "k", "truth", F.date_format("arrived", "yyyy-MM").alias("month"), F.col("arrived").cast("string").alias("arrived"), (F.lit(700) + F.col("chars")).cast("long").alias("cost"))


def review_plan(read: DataFrame) -> DataFrame:
    df = doubtful(read)
    spent = df.groupBy("month").agg(F.lit(500).cast("long").alias("cost"))
    return review.planned(df, df.where("k % 3 = 0"), spent, BUDGET, CAP).select("message_id", "month", "cost", "plan")


def review_results(read: DataFrame, events: tuple[str, ...]) -> DataFrame:
    """Messages after the readings that are known: right ones, of which a part is not sure enough."""
    base = read.select("message_id", F.col("verdict.is_valid").alias("is_valid"), "detected_status", F.col("verdict.confidence").alias("confidence"), F.lit("rules").alias("parsed_by"))
    real = F.col("truth").isin(*events)
    readings = doubtful(read).where("k % 3 = 0").select("message_id", real.alias("is_event"), F.when(real, F.col("truth")).alias("status"), (F.col("k") % 100 / F.lit(100.0)).alias("sureness"))
    return review.corrected(base, readings)


STORE = {f.__name__: f for f in (edit_status, edit_status_events, edit_valid, edit_valid_events, edit_fields, edit_follow_up, migration_events, migration_again)}
