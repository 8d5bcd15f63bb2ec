"""The warehouse: staging, milestones, dimensions, facts, marts. Each model is a function from frames to a frame."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import ALIASES, STATUSES, TRUSTED, channels, statuses
from ..functions.expr import days, days_if_after, filled, key_of, safe_date, safe_double, safe_int
from .build import model

KNOWN = tuple(s[0] for s in STATUSES)


def normal_status(c: Column) -> Column:
    """Older names mapped, unknown ones taken as Applied."""
    x = F.trim(c)
    out = F.when(x.isin(*KNOWN), x)
    for old, new in ALIASES.items():
        out = out.when(x == old, new)
    return out.otherwise("Applied")


@model("raw_applications")
def stg_applications(raw: DataFrame) -> DataFrame:
    """Dated applications that were sent and not judged invalid; typed, trimmed, with defaults. No judgement, or one that cannot be read, is none against."""
    df = raw.select(
        F.col("thread_id").alias("application_id"),
        filled("company_name", "Unknown").alias("company_name"),
        filled("role_title").alias("role_title"),
        filled("source_platform", "Other").alias("platform"),
        safe_date("application_date").alias("applied_date"),
        normal_status(F.col("current_status")).alias("current_status"),
        safe_date("last_updated").alias("last_activity_date"),
        filled("job_description_snippet").alias("job_description"),
        filled("job_url").alias("job_url"),
        filled("gmail_link").alias("gmail_link"),
        filled("latest_subject").alias("latest_subject"),
        filled("job_type", "Full-Time").alias("job_type"),
        filled("seniority_level", "Not Specified").alias("seniority"),
        filled("industry", "Other").alias("industry"),
        filled("role_family", "Other").alias("role_family"),
        filled("location").alias("location"),
        filled("salary_text").alias("salary_text"),
        filled("notes").alias("notes"),
        safe_double("parse_confidence").alias("parse_confidence"),
        filled("parsed_by", "rules").alias("parsed_by"),
        filled("origin", "gmail").alias("origin"),
        safe_int("is_valid").alias("is_valid"),
    )
    return df.where((F.coalesce("is_valid", F.lit(1)) == 1) & (F.col("current_status") != "Saved / Planning") & F.col("applied_date").isNotNull()).drop("is_valid")


@model("raw_events", "status_stages")
def stg_status_events(raw: DataFrame, stages: DataFrame) -> DataFrame:
    """Dated status changes with the stage they reach, whether an employer made them and whether their date is to be trusted."""
    known = F.broadcast(stages.select(F.col("status").alias("stage_status"), F.col("stage_order").alias("stage_to"), F.col("is_employer_response").alias("responds")))  # 8 rows
    df = raw.select(
        "event_id",
        F.col("thread_id").alias("application_id"),
        filled("from_status").alias("from_status"),
        F.trim("to_status").alias("to_status"),
        safe_date("occurred_on").alias("occurred_on"),
        "source",
        filled("message_id").alias("message_id"),
        filled("note").alias("note"),
    ).where(F.col("occurred_on").isNotNull())
    df = df.join(known, F.col("to_status") == F.col("stage_status"), "left")
    by_employer = F.coalesce("responds", F.lit(False)) & (F.col("source") != "system")
    return df.withColumns({"is_employer_response": by_employer, "is_trusted_date": F.col("source").isin(*TRUSTED)}).drop("stage_status", "responds")


@model("raw_messages")
def stg_messages(raw: DataFrame) -> DataFrame:
    """Every message that was read, with its judgement; one without is no application mail."""

    def given(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    return raw.select(
        "message_id",
        F.col("thread_id").alias("application_id"),
        safe_date("message_date").alias("message_date"),
        given("subject").alias("subject"),
        given("sender").alias("sender"),
        (F.coalesce(safe_int("is_valid"), F.lit(0)) == 1).alias("is_application_mail"),
        given("filter_reason").alias("filter_reason"),
        given("detected_status").alias("detected_status"),
        safe_double("confidence").alias("confidence"),
        F.coalesce(given("parsed_by"), F.lit("rules")).alias("parsed_by"),
    )


@model("stg_applications", "stg_status_events", "status_stages")
def milestones(apps: DataFrame, events: DataFrame, stages: DataFrame) -> DataFrame:
    """How far each application got, in its log or its present status, and when. Dates that cannot be trusted stay null."""
    joined = events.join(apps.select("application_id", "applied_date"), "application_id")
    dated = F.col("is_employer_response") & (F.col("is_trusted_date") | (F.col("occurred_on") > F.col("applied_date")))

    def first(status: str) -> Column:
        return F.min(F.when(F.col("to_status") == status, F.col("occurred_on")))

    log = joined.groupBy("application_id").agg(
        F.max("stage_to").alias("log_stage"),
        F.min(F.when(dated, F.col("occurred_on"))).alias("first_response_on"),
        first("Assessment / OA").alias("assessment_on"),
        first("Interview").alias("interview_on"),
        first("Offer").alias("offer_on"),
        F.max(F.when(F.col("to_status").isin("Rejected", "Ghosted", "Withdrawn"), F.col("occurred_on"))).alias("closed_on"),
        F.bool_or("is_employer_response").alias("log_response"),
        F.count(F.lit(1)).alias("event_count"),
        F.bool_or(~F.col("is_trusted_date")).alias("low_trust"),
    )
    now = F.broadcast(stages.select("status", "stage_order", F.col("is_employer_response").alias("responds")))
    df = apps.select("application_id", "current_status").join(log, "application_id", "left").join(now, F.col("current_status") == F.col("status"), "left")
    return df.select(
        "application_id",
        F.greatest(F.coalesce("log_stage", F.lit(0)), F.coalesce("stage_order", F.lit(1)), F.lit(1)).alias("max_stage_reached"),
        (F.coalesce("log_response", F.lit(False)) | F.coalesce("responds", F.lit(False))).alias("is_response"),
        "first_response_on",
        "assessment_on",
        "interview_on",
        "offer_on",
        "closed_on",
        F.coalesce("event_count", F.lit(0)).cast("long").alias("event_count"),
        F.coalesce("low_trust", F.lit(False)).alias("has_low_trust_dates"),
    )


def dimension(apps: DataFrame, column: str, key: str) -> DataFrame:
    """Spellings that differ in case only are one member, under the least of them."""
    return apps.groupBy(key_of(column).alias(key)).agg(F.min(column).alias(column))


@model("stg_applications")
def dim_company(apps: DataFrame) -> DataFrame:
    return dimension(apps, "company_name", "company_key")


@model("stg_applications")
def dim_industry(apps: DataFrame) -> DataFrame:
    return dimension(apps, "industry", "industry_key")


@model("stg_applications")
def dim_job_type(apps: DataFrame) -> DataFrame:
    return dimension(apps, "job_type", "job_type_key")


@model("stg_applications")
def dim_role_family(apps: DataFrame) -> DataFrame:
    return dimension(apps, "role_family", "role_family_key")


@model("stg_applications")
def dim_seniority(apps: DataFrame) -> DataFrame:
    return dimension(apps, "seniority", "seniority_key")


@model("stg_applications", "platform_channels")
def dim_platform(apps: DataFrame, known: DataFrame) -> DataFrame:
    named = apps.groupBy(F.lower("platform").alias("folded")).agg(F.min("platform").alias("platform"))
    seed = known.select(F.lower("platform").alias("seed"), "channel", "is_direct")
    df = named.join(seed, F.col("folded") == F.col("seed"), "left")
    return df.select(key_of("platform").alias("platform_key"), "platform", F.coalesce("channel", F.lit("Other")).alias("channel"), F.coalesce("is_direct", F.lit(False)).alias("is_direct"))


@model("status_stages")
def dim_status(stages: DataFrame) -> DataFrame:
    return stages.withColumnRenamed("status", "status_key")


@model("stg_applications", "as_of")
def dim_date(apps: DataFrame, as_of: date) -> DataFrame:
    """Every day from the first application, or 30 days before as_of, to as_of."""
    today = F.lit(as_of)
    first = apps.agg(F.least(F.coalesce(F.min("applied_date"), today), F.date_sub(today, 30)).alias("first"))
    day = F.col("date_day")
    number = (F.weekday(day) + 1).cast("long")
    return first.select(F.explode(F.sequence("first", today)).alias("date_day")).select(
        day,
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_key"),
        F.year(day).cast("long").alias("year"),
        F.quarter(day).cast("long").alias("quarter"),
        F.month(day).cast("long").alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        F.trunc(day, "week").alias("week_start"),
        number.alias("day_of_week_num"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        (number >= 6).alias("is_weekend"),
        days(day, today).alias("days_ago"),
    )


@model("stg_applications", "milestones", "dim_status", "platform_channels", "as_of")
def fct_applications(apps: DataFrame, miles: DataFrame, status: DataFrame, known: DataFrame, as_of: date) -> DataFrame:
    """One row for each application: what every metric is made from. Its platform's key folds case as its dimension's does."""
    today = F.lit(as_of)
    status = F.broadcast(status.select("status_key", "funnel_stage", "is_terminal", "is_active"))
    platforms = F.broadcast(known.select(F.lower("platform").alias("folded"), F.col("channel").alias("known_channel"), F.col("is_direct").alias("known_direct")))  # a few fixed rows
    df = apps.join(miles, "application_id").join(status, F.col("current_status") == F.col("status_key"), "left").join(platforms, F.lower("platform") == F.col("folded"), "left")
    stage = F.col("max_stage_reached")
    return df.select(
        "application_id",
        *(key_of(c).alias(f"{k}_key") for c, k in (("company_name", "company"), ("role_family", "role_family"), ("seniority", "seniority"), ("industry", "industry"), ("job_type", "job_type"))),
        key_of("platform").alias("platform_key"),
        F.col("current_status").alias("status_key"),
        "applied_date",
        "last_activity_date",
        F.col("first_response_on").alias("first_response_date"),
        "company_name",
        F.coalesce("role_title", F.lit("(role not stated)")).alias("role_title"),
        "platform",
        F.coalesce("known_channel", F.lit("Other")).alias("channel"),
        F.coalesce("known_direct", F.lit(False)).alias("is_direct"),
        *"role_family seniority industry job_type location current_status funnel_stage is_terminal is_active origin parsed_by parse_confidence job_url gmail_link".split(),
        stage,
        "is_response",
        (stage >= 2).alias("reached_assessment"),
        (stage >= 3).alias("reached_interview"),
        (stage >= 4).alias("reached_offer"),
        (F.col("current_status") == "Rejected").alias("is_rejected"),
        (F.col("current_status") == "Ghosted").alias("is_ghosted"),
        days_if_after("applied_date", "first_response_on").alias("days_to_response"),
        days_if_after("applied_date", "interview_on").alias("days_to_interview"),
        days("applied_date", today).alias("days_since_applied"),
        days(F.coalesce("last_activity_date", "applied_date"), today).alias("days_since_activity"),
        F.coalesce(F.length("job_description") >= 40, F.lit(False)).alias("has_job_description"),
        "event_count",
        "has_low_trust_dates",
        F.lit(1).alias("application_count"),
    )


@model("stg_status_events", "fct_applications")
def fct_status_events(events: DataFrame, facts: DataFrame) -> DataFrame:
    df = events.join(facts.select("application_id", "company_name", "role_title", "platform", "applied_date"), "application_id")
    return df.select(
        *"event_id application_id from_status to_status occurred_on source note is_employer_response is_trusted_date company_name role_title platform applied_date".split(),
        days("applied_date", "occurred_on").alias("days_since_applied"),
    )


@model("fct_applications", "dim_date")
def rpt_flat(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """The fact with its application day's calendar columns."""
    names = {"year": "year", "quarter": "quarter", "year_month": "month", "week_start": "week", "day_of_week": "weekday", "day_of_week_num": "weekday_num", "is_weekend": "on_weekend"}
    cal = F.broadcast(calendar.select("date_day", *(F.col(c).alias(f"applied_{n}") for c, n in names.items())))  # a row a day
    return facts.join(cal, F.col("applied_date") == F.col("date_day"), "left").drop("date_day")


@model("stg_messages")
def mart_parser_quality(messages: DataFrame) -> DataFrame:
    """How many messages were judged application mail, or why not, by which reader, and with what confidence."""
    reason = F.coalesce("filter_reason", F.lit("(none)")).alias("filter_reason")
    low = F.count_if(F.coalesce(F.col("confidence") < 0.75, F.lit(False)))
    return messages.groupBy(reason, "is_application_mail", "parsed_by").agg(F.count(F.lit(1)).alias("messages"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), low.alias("low_confidence_messages"))


def seeds(spark: SparkSession) -> dict[str, DataFrame]:
    return {"status_stages": statuses(spark), "platform_channels": channels(spark)}
