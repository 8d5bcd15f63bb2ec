"""Keeping stored tables right: migration of an older version, and repair by a plan of differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import ALIASES
from ..functions import text
from ..functions.expr import filled

EVENT_COLUMNS = "event_id thread_id from_status to_status occurred_on source note".split()


def renamed_statuses(applications: DataFrame) -> DataFrame:
    """Older names of statuses mapped; empty role families made; entries by hand marked as such."""
    status = reduce(lambda out, x: out.when(F.col("current_status") == x[0], x[1]), ALIASES.items(), F.when(F.lit(False), "")).otherwise(F.col("current_status"))
    family = F.coalesce(filled("role_family"), text.labelled("role_title", text.ROLE_FAMILIES, text.OTHER))
    origin = F.when(F.col("thread_id").startswith("manual:"), "manual").otherwise(F.col("origin"))
    made = {"current_status": status, "role_family": family, "origin": origin}
    return applications.select(*(made.get(c, F.col(c)).alias(c) for c in applications.columns))


def missing_events(applications: DataFrame, events: DataFrame, history: DataFrame) -> DataFrame:
    """Events (EVENT_COLUMNS) that a migrated store needs and has not: those of the older history (thread_id, from_status, to_status, changed_at, note), whose dates are not
    trusted; an opening one for each application that was sent; and one for a status that no event tells of, dated by the last news.

    Ids follow from what an event says, and what is there is left out, so a second run finds nothing. Rows of the history that say the same are one event.
    """
    told = F.md5(F.concat_ws("\x00", "thread_id", "from_status", "to_status", "occurred_on", "note"))
    old = history.where(F.coalesce("to_status", F.lit("")) != "").select("thread_id", filled("from_status").alias("from_status"), "to_status", F.substring("changed_at", 1, 10).alias("occurred_on"), F.lit("legacy").alias("source"), F.coalesce("note", F.lit("")).alias("note"))
    old = old.select(F.concat(F.lit("legacy-"), told).alias("event_id"), *EVENT_COLUMNS[1:]).dropDuplicates(["event_id"])
    known = events.select(*EVENT_COLUMNS).unionByName(old.join(events.select("event_id"), "event_id", "left_anti").select(*EVENT_COLUMNS))
    sent = applications.where(F.col("current_status") != "Saved / Planning")

    def inferred(some: DataFrame, kind: str, before, status, day: str, note: str) -> DataFrame:
        return some.select(F.concat(F.lit(f"{kind}-"), "thread_id").alias("event_id"), "thread_id", before.alias("from_status"), status.alias("to_status"), F.substring(day, 1, 10).alias("occurred_on"), F.lit("inferred").alias("source"), F.lit(note).alias("note"))

    begun = known.where(filled("from_status").isNull()).select("thread_id").distinct()
    opening = inferred(sent.join(begun, "thread_id", "left_anti"), "opening", F.lit(None).cast("string"), F.lit("Applied"), "application_date", "opening event reconstructed")
    reached = known.select(F.col("thread_id"), F.col("to_status").alias("current_status")).distinct()
    now = sent.where(F.col("current_status") != "Applied").join(reached, ["thread_id", "current_status"], "left_anti")
    current = inferred(now, "current", F.lit("Applied"), F.col("current_status"), "last_updated", "current status reconstructed")
    return old.unionByName(opening).unionByName(current).join(events.select("event_id"), "event_id", "left_anti").select(*EVENT_COLUMNS)


def migrated(applications: DataFrame, events: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, events) of the newer version; migrating them again changes nothing."""
    df = renamed_statuses(applications)
    return df, events.select(*EVENT_COLUMNS).unionByName(missing_events(df, events, history))


def repair_plan(stored: DataFrame, recomputed: DataFrame, key: str, columns: list[str], why: str = "recomputed") -> DataFrame:
    """(key, column, old, new, why): each value, as text, that is not what it would be if it were computed now. Rows of one side only are left alone; nulls differ from texts."""
    both = stored.alias("s").join(recomputed.select(key, *columns).alias("r"), key)
    changes = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s.{c}").cast("string").alias("old"), F.col(f"r.{c}").cast("string").alias("new")) for c in columns))
    differing = F.filter(changes, lambda x: ~x["old"].eqNullSafe(x["new"]))
    return both.select(key, F.explode(differing).alias("x")).select(key, "x.column", "x.old", "x.new", F.lit(why).alias("why"))


def repaired(stored: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Stored rows after a plan. A row gets at most one entry a column; an entry whose old value is no longer there is out of date and is left out."""
    entries = plan.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("old", "new")))).alias("fix__"))  # as many as columns
    df = stored.join(entries, key, "left")

    def value(c: str):
        kind = stored.schema[c].dataType
        fix = F.try_element_at("fix__", F.lit(c))
        return F.when(fix.isNotNull() & fix["old"].eqNullSafe(F.col(c).cast("string")), fix["new"].cast(kind)).otherwise(F.col(c)).alias(c)

    return df.select(*(F.col(c) if c == key else value(c) for c in stored.columns))
