"""What an operational store does to its tables, as functions from frames to frames: rules, corrections, merges and reads.

Tables hold text, as raw tables do. Nothing is changed in place: each function returns the rows as they are afterwards.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import GHOST_AFTER
from ..functions.expr import filled, safe_date, safe_double, safe_int

LOW_CONFIDENCE = 0.75
SHORT = 240


def is_valid() -> Column:
    return F.coalesce(safe_int("is_valid") == 1, F.lit(False))


def quiet(today: date, after_days: int) -> Column:
    """Valid, applied for, and last heard of more than so many days ago; a date that cannot be read is none."""
    return is_valid() & (F.col("current_status") == "Applied") & (safe_date("last_updated") < F.lit(today - timedelta(days=after_days)))


def ghosted(applications: DataFrame, today: date, after_days: int = GHOST_AFTER) -> tuple[DataFrame, DataFrame]:
    """(applications, events): quiet applications become Ghosted, with an event on the day on which that was due."""
    due = F.least(F.date_add(safe_date("last_updated"), after_days), F.lit(today))
    events = applications.where(quiet(today, after_days)).select(
        "thread_id",
        F.lit("Applied").alias("from_status"),
        F.lit("Ghosted").alias("to_status"),
        due.cast("string").alias("occurred_on"),
        F.lit("system").alias("source"),
        F.lit(f"no reply for {after_days}+ days").alias("note"),
    )
    return applications.withColumn("current_status", F.when(F.coalesce(quiet(today, after_days), F.lit(False)), "Ghosted").otherwise(F.col("current_status"))), events


def last_changes(events: DataFrame) -> DataFrame:
    """The latest event of each thread, by day, then by id, if it changed a status: what an undo takes back."""
    rest = [c for c in events.columns if c != "thread_id"]
    latest = events.groupBy("thread_id").agg(F.max(F.struct("occurred_on", "event_id", *(c for c in rest if c not in ("occurred_on", "event_id")))).alias("e"))
    return latest.select("thread_id", *(F.col("e")[c].alias(c) for c in rest)).where(F.coalesce(F.col("from_status") != "", F.lit(False)))


def undone(applications: DataFrame, events: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, events) after the last change of each of the threads (thread_id) was taken back.

    The status before comes back; last_updated is the day of the latest event that is left, or the application's.
    """
    gone = last_changes(events.join(threads.select("thread_id").distinct(), "thread_id", "left_semi"))
    left = events.join(gone.select("event_id"), "event_id", "left_anti")
    days = left.groupBy("thread_id").agg(F.max(F.substring("occurred_on", 1, 10)).alias("latest"))
    back = gone.select("thread_id", F.col("from_status").alias("back_to")).join(days, "thread_id", "left")
    df = applications.join(back, "thread_id", "left")
    moved = F.col("back_to").isNotNull()
    made = {"current_status": F.coalesce("back_to", "current_status"), "last_updated": F.when(moved, F.coalesce("latest", filled("application_date"))).otherwise(F.col("last_updated"))}
    return df.select(*(made.get(c, F.col(c)).alias(c) for c in applications.columns)), left


def upserted(old: DataFrame, new: DataFrame, key: str, kept_if_empty: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new: a new row takes the place of the old one with its key, but for columns that it leaves empty and that are to be kept then."""
    names = old.columns
    both = old.select(F.col(key).alias("k"), F.struct(*names).alias("o")).join(new.select(F.col(key).alias("k"), F.struct(*names).alias("n")), "k", "full")

    def value(c: str) -> Column:
        given = F.col("n")[c]
        newer = F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(F.col("o")[c]) if c in kept_if_empty else given
        return F.when(F.col("n").isNull(), F.col("o")[c]).otherwise(newer).alias(c)

    return both.select(*(value(c) for c in names))


def enriched(applications: DataFrame, results: DataFrame) -> DataFrame:
    """Applications with what their postings (thread_id, ok, title, description, location, salary) tell: a longer text wins, filled fields win."""
    title, description = filled("title"), filled("description")
    text = F.coalesce(F.concat(title, F.lit(" - "), description), title, description)
    found = results.where("ok").select("thread_id", text.alias("found_text"), filled("location").alias("found_location"), filled("salary").alias("found_salary"))
    df = applications.join(found, "thread_id", "left")
    longer = F.length("found_text") > F.length(F.coalesce("job_description_snippet", F.lit("")))
    made = {
        "job_description_snippet": F.when(longer, F.substring("found_text", 1, 4000)).otherwise(F.col("job_description_snippet")),
        "location": F.coalesce("found_location", "location"),
        "salary_text": F.coalesce("found_salary", "salary_text"),
    }
    return df.select(*(made.get(c, F.col(c)).alias(c) for c in applications.columns))


def to_enrich(applications: DataFrame) -> DataFrame:
    """Threads with a link whose description is short and whose place is unknown."""
    short = F.length(F.coalesce("job_description_snippet", F.lit(""))) < SHORT
    return applications.where(is_valid() & (F.col("job_url") != "") & short & (F.coalesce("location", F.lit("")) == "")).select("thread_id", "job_url", "application_date")


def review_queue(applications: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Applications that were read with little confidence and that nobody has looked at."""
    unsure = safe_double("parse_confidence") < threshold
    unseen = (F.coalesce("origin", F.lit("")) != "manual") & ~F.coalesce("filter_reason", F.lit("")).startswith("manual")
    return applications.where(is_valid() & unsure & unseen).select("thread_id", "company_name", "current_status", safe_double("parse_confidence").alias("parse_confidence"))


def noise(applications: DataFrame) -> DataFrame:
    return applications.where(safe_int("is_valid") == 0).select("thread_id", "application_date", "company_name", "source_platform", "filter_reason")


def changes_since(applications: DataFrame, events: DataFrame, since: str) -> DataFrame:
    """Events recorded since then, with the employer and the role; one without a status before is a new application."""
    known = applications.where(is_valid()).select("thread_id", "company_name", "role_title")
    return events.where(F.col("recorded_at") >= since).join(known, "thread_id").withColumn("is_new", F.coalesce("from_status", F.lit("")) == "")


def counts(applications: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: applications in all, valid ones, noise, and messages read."""
    df = applications.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_valid()).alias("valid"))
    read = messages.agg(F.count(F.lit(1)).alias("messages"))
    return df.crossJoin(F.broadcast(read)).select("total", "valid", (F.col("total") - F.col("valid")).alias("noise"), "messages")  # one row each


def monthly_spend(calls: DataFrame) -> DataFrame:
    """Calls of a paid reader by month: how many, tokens in and out, and cost."""
    month = F.substring("created_at", 1, 7).alias("month")
    sums = (F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd"))
    return calls.groupBy(month).agg(F.count(F.lit(1)).alias("calls"), *sums)
