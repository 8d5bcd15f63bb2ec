"""The vocabulary of a staged pipeline: statuses, stages, channels, sources and the figures rates are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Status, funnel stage, stage order, terminal, active, employer's response, sort order.
STATUSES = (
    ("Saved / Planning", "Pre-application", 0, False, False, False, 0),
    ("Applied", "Applied", 1, False, True, False, 1),
    ("Assessment / OA", "Assessment", 2, False, True, True, 2),
    ("Interview", "Interview", 3, False, True, True, 3),
    ("Offer", "Offer", 4, True, False, True, 4),
    ("Rejected", "Closed", 0, True, False, True, 5),
    ("Ghosted", "Closed", 0, True, False, False, 6),
    ("Withdrawn", "Closed", 0, True, False, False, 7),
)
# Older names of statuses.
ALIASES = {"Screening/OA": "Assessment / OA", "Response": "Assessment / OA", "Ghosted/Inactive": "Ghosted"}
# Rank by which the strongest of several detected statuses wins.
RANK = {"Rejected": 5, "Offer": 4, "Interview": 3, "Assessment / OA": 2, "Applied": 1, "Ghosted": -1, "Withdrawn": -1}
# Where an event can come from, and those whose dates are trusted.
SOURCES = ("gmail", "manual", "llm", "repair", "system", "legacy", "inferred")
TRUSTED = ("gmail", "manual", "llm", "repair", "system")
# Benchmarks.
BANDS = (("Strong", 5.0), ("Good", 3.0), ("Average", 2.0), ("Below average", 0.0))
DIRECT_INTERVIEW_PCT, BOARD_INTERVIEW_PCT = 6.87, 1.95
PER_100 = {"Interview": (5.0, 10.0), "Offer": (0.0, 1.0)}
ADEQUATE, INDICATIVE = 30, 10
Z = 1.96
GHOST_AFTER, FOLLOW_UP_AFTER = 21, 7

#: Channels of the driver tables' platforms; the last platform is left out, to meet the default.
CHANNELS = (("1-URGENT", "Job board", False), ("2-HIGH", "Graduate board", False), ("3-MEDIUM", "Employer careers site", True), ("4-NOT SPECIFIED", "Referral", True))


def inline(spark: SparkSession, rows, *names: str) -> DataFrame:
    """A few fixed rows as a part of the plan, whose size Catalyst knows."""
    values = ", ".join("(" + ", ".join("'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS v({', '.join(names)})")


def statuses(spark: SparkSession) -> DataFrame:
    return inline(spark, STATUSES, "status", "funnel_stage", "stage_order", "is_terminal", "is_active", "is_employer_response", "sort_order")


def channels(spark: SparkSession, rows=CHANNELS) -> DataFrame:
    return inline(spark, rows, "platform", "channel", "is_direct")
