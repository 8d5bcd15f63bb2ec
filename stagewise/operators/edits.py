"""What people change by hand in the store's tables, as functions from frames to frames. Edits come as a frame, one row a thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.expr import filled
from ..plans.models import normal_status

#: Columns of an application that may be overwritten, and the longest text.
EDITABLE = tuple("company_name role_title source_platform job_url notes location salary_text job_type industry seniority_level".split())
LONGEST, LONGEST_NOTES = 2000, 4000


def replaced(applications: DataFrame, made: dict[str, Column]) -> DataFrame:
    """The applications' own columns, some of them made anew; columns of a joined frame go."""
    return applications.select(*(made.get(c, F.col(c)).alias(c) for c in applications.columns if not c.startswith("e__")))


def joined(applications: DataFrame, edits: DataFrame) -> DataFrame:
    """Applications with the columns of their edit, as e__name; e__given tells whether there is one."""
    renamed = edits.select(F.col("thread_id").alias("e__id"), *(F.col(c).alias(f"e__{c}") for c in edits.columns if c != "thread_id"), F.lit(True).alias("e__given"))
    return applications.join(renamed, F.col("thread_id") == F.col("e__id"), "left").withColumn("e__given", F.coalesce("e__given", F.lit(False)))


def set_status(applications: DataFrame, edits: DataFrame, source: str = "manual") -> tuple[DataFrame, DataFrame]:
    """(applications, new events) after edits (thread_id, status, day, note). The same status again changes nothing; a saved one that is sent begins on that day."""
    df = joined(applications, edits)
    status, day = normal_status(F.col("e__status")), F.substring("e__day", 1, 10)
    change = F.col("e__given") & (status != F.col("current_status"))
    sent = change & (F.col("current_status") == "Saved / Planning") & (status == "Applied")
    events = df.where(change).select("thread_id", F.col("current_status").alias("from_status"), status.alias("to_status"), day.alias("occurred_on"), F.lit(source).alias("source"), F.coalesce("e__note", F.lit("")).alias("note"))
    made = {"current_status": F.when(change, status), "last_updated": F.when(change, day), "application_date": F.when(sent, day)}
    return replaced(df, {c: F.when(change if c != "application_date" else sent, v).otherwise(F.col(c)) for c, v in made.items()}), events


def set_valid(applications: DataFrame, events: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, new events) after verdicts (thread_id, valid, reason), which stay: the reason says that they were made by hand. A recovered thread without events gets its opening one."""
    df = joined(applications, edits)
    given = F.coalesce(filled("e__reason"), F.when(F.col("e__valid"), "manual recovery").otherwise("manual: marked as noise"))
    reason = F.when(given.startswith("manual"), given).otherwise(F.concat(F.lit("manual: "), given))
    made = {"is_valid": F.when(F.col("e__given"), F.when(F.col("e__valid"), "1").otherwise("0")).otherwise(F.col("is_valid")), "filter_reason": F.when(F.col("e__given"), reason).otherwise(F.col("filter_reason"))}
    bare = df.where(F.col("e__given") & F.col("e__valid")).join(events.select("thread_id").distinct(), "thread_id", "left_anti")
    opening = bare.select("thread_id", F.lit(None).cast("string").alias("from_status"), F.lit("Applied").alias("to_status"), F.substring("application_date", 1, 10).alias("occurred_on"), F.lit("manual").alias("source"), F.lit("recovered from the noise filter").alias("note"))
    return replaced(df, made), opening


def update_fields(applications: DataFrame, edits: DataFrame) -> DataFrame:
    """Applications after edits (thread_id and some of EDITABLE; null: leave it). Texts are trimmed and cut; a new role brings its family."""
    if unknown := set(edits.columns) - {"thread_id", *EDITABLE}:
        raise ValueError(f"not editable: {sorted(unknown)}")
    df = joined(applications, edits)
    made = {c: F.coalesce(F.substring(F.trim(F.col(f"e__{c}")), 1, LONGEST), F.col(c)) for c in EDITABLE if c in edits.columns}
    if "role_title" in edits.columns:
        family = text.labelled("e__role_title", text.ROLE_FAMILIES, text.OTHER)
        made["role_family"] = F.when(F.col("e__role_title").isNotNull(), family).otherwise(F.col("role_family"))
    return replaced(df, made)


def followed_up(applications: DataFrame, edits: DataFrame) -> DataFrame:
    """Applications after reminders (thread_id, day, note): a dated line is added to the notes, of which the last LONGEST_NOTES characters stay, and silence is counted from that day."""
    df = joined(applications, edits)
    line = F.concat(F.lit("["), F.col("e__day"), F.lit("] Followed up"), F.coalesce(F.concat(F.lit(": "), filled("e__note")), F.lit("")))
    notes = F.concat_ws("\n", filled("notes"), line)
    return replaced(df, {"notes": F.when(F.col("e__given"), F.substring(notes, -LONGEST_NOTES, LONGEST_NOTES)).otherwise(F.col("notes")), "last_updated": F.when(F.col("e__given"), F.col("e__day")).otherwise(F.col("last_updated"))})


def added(applications: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, new events) with entries (company, role, platform, day, status) that no mail told of; their ids follow from what they say, so an entry twice is one."""
    role, company, status = F.trim(F.coalesce("role", F.lit(""))), F.coalesce(filled("company"), F.lit("Unknown")), normal_status(F.col("status"))
    key = F.concat(F.lit("manual:"), F.substring(F.md5(F.concat_ws("\x00", company, role, "day")), 1, 12))
    said = {
        "thread_id": key, "company_name": company, "role_title": role, "source_platform": F.coalesce(filled("platform"), F.lit("Other")), "application_date": F.col("day"), "current_status": status, "last_updated": F.col("day"),
        "latest_subject": F.concat(F.lit("Manual entry: "), role), "is_valid": F.lit("1"), "filter_reason": F.lit("manual entry"), "job_type": text.labelled(role, text.JOB_TYPES, text.JOB_TYPE), "seniority_level": text.labelled(role, text.SENIORITIES, text.SENIORITY),
        "industry": text.labelled(F.concat_ws(" ", company, role), text.INDUSTRIES, text.OTHER), "role_family": text.labelled(role, text.ROLE_FAMILIES, text.OTHER), "parsed_by": F.lit("manual"), "origin": F.lit("manual"),
    }
    new = entries.select(*(said.get(c, F.lit("").cast("string")).alias(c) for c in applications.columns)).dropDuplicates(["thread_id"]).join(applications.select("thread_id"), "thread_id", "left_anti").select(*applications.columns)
    opening = F.when(F.col("current_status") != "Saved / Planning", F.struct(F.lit(None).cast("string").alias("from_status"), F.lit("Applied").alias("to_status"), F.lit("logged manually").alias("note")))
    further = F.when(~F.col("current_status").isin("Saved / Planning", "Applied"), F.struct(F.lit("Applied").alias("from_status"), F.col("current_status").alias("to_status"), F.lit("").alias("note")))
    events = new.select("thread_id", F.explode(F.filter(F.array(opening, further), lambda e: e.isNotNull())).alias("e"), F.col("application_date").alias("occurred_on")).select("thread_id", "e.from_status", "e.to_status", "occurred_on", F.lit("manual").alias("source"), "e.note")
    return applications.unionByName(new), events


def deleted(applications: DataFrame, events: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, events) without those of the threads (thread_id)."""
    gone = threads.select("thread_id")
    return applications.join(gone, "thread_id", "left_anti").select(*applications.columns), events.join(gone, "thread_id", "left_anti").select(*events.columns)
