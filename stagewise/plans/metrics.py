"""The named metrics. Each takes the filtered fact (and what else it names) and returns a frame."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import DIRECT_INTERVIEW_PCT, FOLLOW_UP_AFTER, GHOST_AFTER, PER_100
from ..functions.expr import band, confidence, count_where, median, pct, wilson
from ..operators.filters import SEGMENTS, Filters


def total() -> Column:
    return F.count(F.lit(1))


def replied() -> Column:
    return count_where("is_response")


def interviewed() -> Column:
    return count_where("reached_interview")


def kpis(base: DataFrame, follow_up_days: int = FOLLOW_UP_AFTER) -> DataFrame:
    """The headline row."""
    flags = {"responses": "is_response", "assessments": "reached_assessment", "interviews": "reached_interview", "offers": "reached_offer", "rejections": "is_rejected", "ghosted": "is_ghosted", "active": "is_active"}
    df = base.agg(
        total().alias("applications"),
        *(count_where(c).alias(k) for k, c in flags.items()),
        count_where(F.col("is_active") & (F.col("days_since_activity") >= follow_up_days)).alias("needs_follow_up"),
        F.count_distinct("company_name").alias("companies"),
        median("days_to_response").alias("median_days_to_response"),
        F.round(F.avg("days_to_response"), 1).alias("avg_days_to_response"),
        F.count("days_to_response").alias("responses_with_known_date"),
        median("days_to_interview").alias("median_days_to_interview"),
        pct(count_where("is_direct"), total()).alias("direct_share_pct"),
        F.min("applied_date").alias("first_applied"),
        F.max("applied_date").alias("last_applied"),
    )
    n = F.col("applications")
    rates = {"response_rate_pct": "responses", "interview_rate_pct": "interviews", "offer_rate_pct": "offers", "rejection_rate_pct": "rejections", "ghost_rate_pct": "ghosted"}
    bounds = {f"{k}_rate_{b}": wilson(F.col(c), n, b == "hi") for k, c in (("response", "responses"), ("interview", "interviews")) for b in ("lo", "hi")}
    return df.withColumns({k: pct(F.col(c), n) for k, c in rates.items()} | bounds).withColumn("response_band", band(F.col("response_rate_pct")))


def period_compare(base: DataFrame, as_of: date) -> DataFrame:
    """The last 30 days and the 30 before them."""
    applied = F.col("applied_date")
    last = applied > F.date_sub(F.lit(as_of), 30)
    prev = ~last & (applied > F.date_sub(F.lit(as_of), 60))
    n = {k: count_where(c) for k, c in (("last_30", last), ("prev_30", prev))}
    return base.agg(
        *(v.alias(k) for k, v in n.items()),
        (n["last_30"] - n["prev_30"]).alias("change"),
        *(pct(count_where(c & F.col("is_response")), n[k]).alias(f"{k}_response_pct") for k, c in (("last_30", last), ("prev_30", prev))),
    )


def funnel(base: DataFrame) -> DataFrame:
    """One pass over the fact; five rows with step conversion and the published ranges."""
    steps = (("Applied", total()), ("Employer responded", replied()), ("Assessment", count_where("reached_assessment")), ("Interview", interviewed()), ("Offer", count_where("reached_offer")))
    counts = base.agg(*(c.alias(f"n{i}") for i, (_, c) in enumerate(steps)))
    rows = [
        F.struct(F.lit(i + 1).alias("stage_order"), F.lit(name).alias("stage"), F.col(f"n{i}").alias("applications"), *(F.lit(PER_100.get(name, (None, None))[k]).cast("double").alias(f"benchmark_per_100_{b}") for k, b in enumerate(("lo", "hi"))))
        for i, (name, _) in enumerate(steps)
    ]
    df = counts.select(F.inline(F.array(*rows)))
    w = Window.orderBy("stage_order")  # five rows
    n, first, before = F.col("applications"), F.first("applications").over(w), F.lag("applications").over(w)
    lo, hi = F.col("benchmark_per_100_lo"), F.col("benchmark_per_100_hi")
    share = F.lit(100.0) * n / F.nullif(first, F.lit(0))
    versus = F.when(lo.isNotNull(), F.when(share > hi, "Ahead").when(share >= lo, "On par").otherwise("Behind"))
    return df.withColumns({"pct_of_applied": pct(n, first), "step_conversion_pct": pct(n, before), "lost_at_step": before - n, "vs_benchmark": versus}).orderBy("stage_order")


def sankey(base: DataFrame) -> DataFrame:
    """Flows between stages in one pass: each application gives the flows it took."""
    stage, active, ghosted, rejected = F.col("max_stage_reached"), F.col("is_active"), F.col("is_ghosted"), F.col("is_rejected")
    withdrawn = F.col("current_status") == "Withdrawn"
    tests, talks = F.col("reached_assessment"), F.col("reached_interview")
    flows = [("Applied", "Assessment", tests), ("Applied", "Interview", talks & ~tests)]
    flows += [("Applied", to, (stage == 1) & c) for to, c in (("Rejected", rejected), ("Ghosted", ghosted), ("Awaiting reply", active), ("Withdrawn", withdrawn))]
    flows += [("Assessment", "Interview", tests & talks), ("Interview", "Offer", F.col("reached_offer"))]
    flows += [(at, to, (stage == k) & c) for at, k in (("Assessment", 2), ("Interview", 3)) for to, c in (("Rejected", rejected), ("In progress", active), ("Ghosted", ghosted | withdrawn))]
    taken = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"))) for a, b, c in flows]))
    return base.select(F.inline(taken)).groupBy("source", "target").agg(total().alias("applications")).orderBy("source", F.desc("applications"), "target")


def weekly_velocity(base: DataFrame, calendar: DataFrame, as_of: date) -> DataFrame:
    """Weeks without applications included; rolling four-week mean and running total."""
    first = base.agg(F.min("applied_date").alias("first"))
    weeks = calendar.join(F.broadcast(first), (F.col("date_day") >= F.col("first")) & (F.col("date_day") <= F.lit(as_of))).select("week_start").distinct()  # one row
    counts = base.groupBy(F.trunc("applied_date", "week").alias("week")).agg(total().alias("applications"), replied().alias("responses"), interviewed().alias("interviews"))
    df = weeks.join(counts, F.col("week_start") == F.col("week"), "left").select("week_start", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("applications", "responses", "interviews")))
    w = Window.orderBy("week_start")  # a row a week
    return df.withColumns({"rolling_4w_avg": F.round(F.avg("applications").over(w.rowsBetween(-3, 0)), 1), "cumulative": F.sum("applications").over(w)}).orderBy("week_start")


def monthly_cohorts(base: DataFrame) -> DataFrame:
    names = {"responses": "is_response", "interviews": "reached_interview", "offers": "reached_offer", "rejected": "is_rejected", "ghosted": "is_ghosted", "still_open": "is_active"}
    return base.groupBy(F.date_format("applied_date", "yyyy-MM").alias("cohort_month")).agg(
        total().alias("applications"),
        *(count_where(c).alias(k) for k, c in names.items()),
        pct(replied(), total()).alias("response_rate_pct"),
        pct(interviewed(), total()).alias("interview_rate_pct"),
        (F.max("days_since_applied") < 30).alias("is_maturing"),
    ).orderBy("cohort_month")


def _rates() -> list:
    return [
        total().alias("applications"),
        replied().alias("responses"),
        interviewed().alias("interviews"),
        count_where("reached_offer").alias("offers"),
        pct(replied(), total()).alias("response_rate_pct"),
        wilson(replied(), total(), False).alias("response_rate_lo"),
        wilson(replied(), total(), True).alias("response_rate_hi"),
        pct(interviewed(), total()).alias("interview_rate_pct"),
        median("days_to_response").alias("median_days_to_response"),
    ]


def platform_performance(base: DataFrame) -> DataFrame:
    df = base.groupBy("platform").agg(F.min("channel").alias("channel"), F.bool_or("is_direct").alias("is_direct"), *_rates())
    everyone, n = Window.partitionBy(), F.col("applications")  # a row a platform
    return df.withColumns({
        "vs_direct_benchmark_pp": F.round(F.lit(100.0) * F.col("interviews") / n - F.lit(DIRECT_INTERVIEW_PCT), 1),
        "share_pct": pct(n, F.sum(n).over(everyone)),
        "response_rank": F.dense_rank().over(Window.orderBy(F.desc(F.col("responses").cast("double") / n))).cast("long"),
        "sample_confidence": confidence(n),
    }).orderBy(F.desc("applications"), "platform")


def segment_performance(base: DataFrame, segment: str) -> DataFrame:
    """segment is one of SEGMENTS; anything else is an error."""
    return base.groupBy(F.col(SEGMENTS[segment]).alias("segment")).agg(*_rates()).orderBy(F.desc("applications"), "segment")


def response_survival(base: DataFrame) -> DataFrame:
    """Kaplan-Meier: who still waits is censored at its age; replies of unknown date cannot be placed."""
    t = F.when(F.col("is_response"), F.col("days_to_response")).otherwise(F.col("days_since_applied"))
    placed = base.where(~F.col("is_response") | F.col("days_to_response").isNotNull())
    at = placed.groupBy(t.alias("day")).agg(replied().alias("responses"), count_where(~F.col("is_response")).alias("censored"), total().alias("n"))
    at = at.withColumn("at_risk", F.sum("n").over(Window.orderBy(F.desc("day"))))  # a row a day
    kept = F.greatest(F.lit(1.0) - F.col("responses") / F.col("at_risk"), F.lit(1e-12))
    df = at.withColumn("survival", F.exp(F.sum(F.ln(kept)).over(Window.orderBy("day"))))
    return df.select("day", "at_risk", "responses", "censored", F.round(F.lit(100.0) * F.col("survival"), 2).alias("still_waiting_pct"), F.round(F.lit(100.0) * (F.lit(1.0) - F.col("survival")), 2).alias("replied_pct")).orderBy("day")


def response_time_buckets(base: DataFrame) -> DataFrame:
    d = F.col("days_to_response")
    bucket = F.when(d <= 3, "0-3 days").when(d <= 7, "4-7 days").when(d <= 14, "1-2 weeks").when(d <= 30, "2-4 weeks").otherwise("1 month+")
    df = base.where(d.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.min(d).alias("sort_key"), total().alias("responses"), count_where("is_rejected").alias("rejections"), count_where("reached_assessment").alias("progressed"))
    return df.withColumn("share_pct", pct(F.col("responses"), F.sum("responses").over(Window.partitionBy()))).orderBy("sort_key")


def weekday_performance(base: DataFrame) -> DataFrame:
    number = (F.weekday("applied_date") + 1).cast("long")
    return base.groupBy(number.alias("weekday_num"), F.date_format("applied_date", "EEE").alias("weekday")).agg(total().alias("applications"), replied().alias("responses"), pct(replied(), total()).alias("response_rate_pct")).orderBy("weekday_num")


def activity_calendar(base: DataFrame, calendar: DataFrame, as_of: date) -> DataFrame:
    """A row for each of the last 182 days; the counts are made before days meet them."""
    counts = base.groupBy("applied_date").agg(total().alias("n"))
    days = calendar.where(F.col("date_day") > F.date_sub(F.lit(as_of), 182)).select("date_day", "week_start", "day_of_week_num")
    return days.join(counts, F.col("date_day") == F.col("applied_date"), "left").select("date_day", "week_start", "day_of_week_num", F.coalesce("n", F.lit(0)).alias("applications")).orderBy("date_day")


def status_mix(base: DataFrame, status: DataFrame) -> DataFrame:
    df = base.groupBy(F.col("current_status").alias("status")).agg(total().alias("applications"), F.round(F.avg("days_since_activity"), 1).alias("avg_days_since_activity"))
    df = df.join(F.broadcast(status.select("status_key", "sort_order")), F.col("status") == F.col("status_key"), "left").drop("status_key")
    return df.withColumn("share_pct", pct(F.col("applications"), F.sum("applications").over(Window.partitionBy()))).orderBy("sort_order")


def stage_timing(base: DataFrame) -> DataFrame:
    """One pass, two rows."""
    made = {}
    for i, c in enumerate(("days_to_response", "days_to_interview")):
        made |= {f"n{i}": F.count(c), f"m{i}": median(c), f"a{i}": F.percentile(c, 0.25), f"b{i}": F.percentile(c, 0.75)}
    rows = [
        F.struct(F.lit(name).alias("milestone"), F.lit(i + 1).alias("sort_order"), F.col(f"n{i}").alias("applications"), F.col(f"m{i}").alias("median_days"), F.col(f"a{i}").alias("p25_days"), F.col(f"b{i}").alias("p75_days"))
        for i, name in enumerate(("First reply", "Interview"))
    ]
    return base.agg(*(v.alias(k) for k, v in made.items())).select(F.inline(F.array(*rows))).orderBy("sort_order")


def company_leaderboard(base: DataFrame) -> DataFrame:
    return base.groupBy("company_name").agg(
        F.min("industry").alias("industry"),
        total().alias("applications"),
        F.count_distinct("role_title").alias("distinct_roles"),
        replied().alias("responses"),
        interviewed().alias("interviews"),
        count_where("reached_offer").alias("offers"),
        count_where("is_active").alias("open"),
        pct(replied(), total()).alias("response_rate_pct"),
        F.max("applied_date").alias("last_applied"),
    ).orderBy(F.desc("applications"), F.desc("interviews"), "company_name")


def follow_up_queue(base: DataFrame, follow_up_days: int = FOLLOW_UP_AFTER, ghost_after_days: int = GHOST_AFTER) -> DataFrame:
    quiet = F.col("days_since_activity")
    action = (
        F.when(F.col("current_status") == "Interview", "Thank-you / status check")
        .when(F.col("current_status") == "Assessment / OA", "Confirm the assessment was received")
        .when(quiet >= ghost_after_days - 3, "Final nudge")
        .otherwise("Polite follow-up")
    )
    names = "application_id company_name role_title platform current_status applied_date last_activity_date days_since_activity gmail_link job_url".split()
    return base.where(F.col("is_active") & (quiet >= follow_up_days)).select(*names, action.alias("suggested_action")).orderBy(F.desc("days_since_activity"), "application_id")


def transitions(base: DataFrame, events: DataFrame) -> DataFrame:
    df = events.where(~F.col("from_status").eqNullSafe(F.col("to_status"))).join(base.select("application_id"), "application_id", "left_semi")
    return df.groupBy(F.coalesce("from_status", F.lit("(new)")).alias("from_status"), "to_status").agg(total().alias("transitions"), F.round(F.avg("days_since_applied"), 1).alias("avg_days_since_applied")).orderBy(F.desc("transitions"), "from_status", "to_status")


def recent_activity(base: DataFrame, events: DataFrame, rows: int = 40) -> DataFrame:
    """The newest movements; event ids are text and are ordered as text."""
    df = events.join(base.select("application_id"), "application_id", "left_semi").orderBy(F.desc("occurred_on"), F.desc("event_id")).limit(rows)
    return df.select("occurred_on", "company_name", "role_title", "from_status", "to_status", "source", "note", "application_id")


def data_quality(base: DataFrame) -> DataFrame:
    """Seven checks in one pass."""
    checks = (
        ("Employer identified", count_where(F.col("company_name") != "Unknown"), total()),
        ("Role title identified", count_where(F.col("role_title") != "(role not stated)"), total()),
        ("Job description captured", count_where("has_job_description"), total()),
        ("Posting link captured", F.count("job_url"), total()),
        ("Reply date known (of replies)", F.count("days_to_response"), replied()),
        ("High-confidence parse", count_where((F.coalesce("parse_confidence", F.lit(1.0)) >= 0.75) | (F.col("origin") == "manual")), total()),
        ("Event dates from source emails", count_where(~F.col("has_low_trust_dates")), total()),
    )
    made = base.agg(*(c.alias(f"{k}{i}") for i, (_, p, t) in enumerate(checks) for k, c in (("p", p), ("t", t))))
    return made.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"p{i}").alias("passing"), F.col(f"t{i}").alias("total")) for i, (n, _, _) in enumerate(checks)])))


def applications(base: DataFrame) -> DataFrame:
    names = (
        "application_id company_name role_title platform channel role_family seniority industry job_type location current_status funnel_stage max_stage_reached applied_date "
        "last_activity_date first_response_date days_to_response days_since_activity is_response reached_interview is_active origin parsed_by parse_confidence job_url gmail_link"
    )
    return base.select(*names.split()).orderBy(F.desc("applied_date"), "company_name", "application_id")


def parser_quality(mart: DataFrame) -> DataFrame:
    return mart.orderBy(F.desc("messages"), "filter_reason", "is_application_mail", "parsed_by")


def filter_options(facts: DataFrame) -> DataFrame:
    """Values to filter by, with counts, in one pass: a row for each value of an application."""
    names = {"platform": "platform", "status": "current_status", "role_family": "role_family", "industry": "industry", "job_type": "job_type"}
    pairs = F.array(*[F.struct(F.lit(k).alias("dim"), F.col(c).alias("value")) for k, c in names.items()])
    return facts.select(F.inline(pairs)).groupBy("dim", "value").agg(total().alias("n")).orderBy("dim", F.desc("n"), "value")


def date_bounds(facts: DataFrame) -> DataFrame:
    return facts.agg(F.min("applied_date").alias("first"), F.max("applied_date").alias("last"))


class Metrics:
    """Metrics by name over one build, under one filter."""

    ON_BASE = {f.__name__: f for f in (kpis, funnel, sankey, monthly_cohorts, platform_performance, response_survival, response_time_buckets, weekday_performance, stage_timing, company_leaderboard, follow_up_queue, data_quality, applications)}

    def __init__(self, frames: dict, as_of: date, filters: Filters | None = None, follow_up_days: int = FOLLOW_UP_AFTER, ghost_after_days: int = GHOST_AFTER) -> None:
        self.frames, self.as_of, self.follow_up_days, self.ghost_after_days = frames, as_of, follow_up_days, ghost_after_days
        self.base = (filters or Filters()).apply(frames["fct_applications"], follow_up_days)
        self.more = {
            "kpis": lambda: kpis(self.base, follow_up_days),
            "follow_up_queue": lambda: follow_up_queue(self.base, follow_up_days, ghost_after_days),
            "period_compare": lambda: period_compare(self.base, as_of),
            "weekly_velocity": lambda: weekly_velocity(self.base, frames["dim_date"], as_of),
            "activity_calendar": lambda: activity_calendar(self.base, frames["dim_date"], as_of),
            "status_mix": lambda: status_mix(self.base, frames["dim_status"]),
            "transitions": lambda: transitions(self.base, frames["fct_status_events"]),
            "recent_activity": lambda: recent_activity(self.base, frames["fct_status_events"]),
            "parser_quality": lambda: parser_quality(frames["mart_parser_quality"]),
            "filter_options": lambda: filter_options(frames["fct_applications"]),
            "date_bounds": lambda: date_bounds(frames["fct_applications"]),
        }

    def names(self) -> list[str]:
        return sorted({*self.ON_BASE, *self.more, "segment_performance"})

    def query(self, name: str, segment: str = "industry") -> DataFrame:
        if name == "segment_performance":
            return segment_performance(self.base, segment)
        return self.more[name]() if name in self.more else self.ON_BASE[name](self.base)

    def all(self) -> dict[str, DataFrame]:
        """All metrics, segments one by one; the filtered fact is kept for them."""
        self.base = self.base.cache()
        return {n: self.query(n) for n in self.names() if n != "segment_performance"} | {f"segment_{s}": self.query("segment_performance", s) for s in SEGMENTS}
