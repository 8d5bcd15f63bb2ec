"""Data tests over a build: each gives the number of rows that break it. Every test has a name: what it tests, the model, the column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import STATUSES

SENT = [s[0] for s in STATUSES if s[6] > 0]

# Keys, columns without nulls, and references to keys of other models.
KEYS = {
    "raw_applications": "thread_id",
    "raw_events": "event_id",
    "stg_applications": "application_id",
    "stg_status_events": "event_id",
    "stg_messages": "message_id",
    "fct_applications": "application_id",
    "fct_status_events": "event_id",
    "dim_date": "date_day",
    "dim_company": "company_key",
    "dim_platform": "platform_key",
    "dim_status": "status_key",
    "dim_role_family": "role_family_key",
    "dim_industry": "industry_key",
    "dim_job_type": "job_type_key",
    "dim_seniority": "seniority_key",
}
FILLED = {"stg_applications": ("applied_date", "current_status"), "stg_status_events": ("occurred_on",), "fct_applications": ("company_key", "platform_key", "status_key", "applied_date")}
REFERENCES = (
    ("fct_applications", "company_key", "dim_company"),
    ("fct_applications", "platform_key", "dim_platform"),
    ("fct_applications", "status_key", "dim_status"),
    ("fct_applications", "role_family_key", "dim_role_family"),
    ("fct_applications", "applied_date", "dim_date"),
    ("fct_status_events", "application_id", "fct_applications"),
)


def failing(df: DataFrame, broken: dict[str, Column]) -> DataFrame:
    """(test, failures): rows for which each condition holds, all in one pass; an unknown outcome is no failure."""
    counts = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in broken.items()))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("test"), F.col(n).alias("failures")) for n in broken])))


def unique(df: DataFrame, model: str, column: str) -> DataFrame:
    """Values that stand in more than one row; nulls are not compared."""
    return failing(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")), {f"unique_{model}_{column}": F.col("n") > 1})


def related(df: DataFrame, model: str, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose value is no key of the other frame; nulls refer to nothing. Values are counted before they meet the keys."""
    used = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    lost = used.join(keys.select(F.col(key).alias("known_key")), F.col(column) == F.col("known_key"), "left_anti")
    return lost.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("failures")).select(F.lit(f"related_{model}_{column}").alias("test"), "failures")


def contiguous(calendar: DataFrame) -> DataFrame:
    """Days missing between a calendar's first and last."""
    missing = F.coalesce(F.datediff(F.max("date_day"), F.min("date_day")) + 1 - F.count_distinct("date_day"), F.lit(0)).cast("long")
    return calendar.agg(missing.alias("failures")).select(F.lit("calendar_is_contiguous").alias("test"), "failures")


def monotone(facts: DataFrame) -> DataFrame:
    """Whether a stage of the funnel holds more applications than the one before: 1 or 0."""
    counts = [F.count(F.lit(1)), *(F.count_if(f"reached_{s}") for s in ("assessment", "interview", "offer"))]
    wider = reduce(lambda x, y: x | y, (b > a for a, b in zip(counts, counts[1:], strict=False)))
    return facts.agg(wider.cast("long").alias("failures")).select(F.lit("funnel_is_monotone").alias("test"), "failures")


def of_rows(model: str) -> dict[str, Column]:
    """The tests of a model that look at one row."""
    out = {f"not_null_{model}_{c}": F.col(c).isNull() for c in (KEYS[model], *FILLED.get(model, ()))}
    if model == "stg_applications":
        out["accepted_stg_applications_current_status"] = ~F.col("current_status").isin(SENT)
    if model == "fct_applications":
        out |= {
            "accepted_fct_applications_max_stage_reached": ~F.col("max_stage_reached").isin(1, 2, 3, 4),
            "no_negative_durations": (F.col("days_to_response") < 0) | (F.col("days_to_interview") < 0) | (F.col("days_since_applied") < 0),
            "outcomes_imply_a_response": (F.col("reached_assessment") | F.col("is_rejected")) & ~F.col("is_response"),
            "no_reply_time_without_a_response": ~F.col("is_response") & F.col("days_to_response").isNotNull(),
        }
    return out


def data_tests(frames: dict[str, DataFrame]) -> DataFrame:
    """(test, failures) of all tests over frames by name: those of KEYS."""
    out = [contiguous(frames["dim_date"]), monotone(frames["fct_applications"])]
    for model, key in KEYS.items():
        out += [unique(frames[model], model, key), failing(frames[model], of_rows(model))]
    for model, column, to in REFERENCES:
        out.append(related(frames[model], model, column, frames[to], KEYS[to]))
    return reduce(DataFrame.unionByName, out)
