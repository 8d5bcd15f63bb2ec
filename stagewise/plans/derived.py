"""What a reader takes from the metrics: marks on the waiting curve, best and worst of a segment, fixed levels of detail, roles of the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import INDICATIVE
from ..functions.expr import count_where, pct, wilson
from ..operators.filters import SEGMENTS

HORIZONS = (7, 14, 21, 30)


def curves(facts: DataFrame, key: Column) -> DataFrame:
    """Kaplan-Meier curves by key: key, day, still_waiting_pct. Who still waits is censored at its age; replies of unknown date cannot be placed."""
    t = F.when(F.col("is_response"), F.col("days_to_response")).otherwise(F.col("days_since_applied"))
    placed = facts.where(~F.col("is_response") | F.col("days_to_response").isNotNull())
    at = placed.groupBy(key.alias("key"), t.alias("day")).agg(count_where("is_response").alias("replies"), F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy("key").orderBy(F.desc("day"))  # a row a day
    kept = F.greatest(F.lit(1.0) - F.col("replies") / F.col("at_risk"), F.lit(1e-12))
    waiting = F.exp(F.sum(F.ln(kept)).over(Window.partitionBy("key").orderBy("day")))
    return at.withColumn("at_risk", F.sum("n").over(later)).select("key", "day", F.round(F.lit(100.0) * waiting, 2).alias("still_waiting_pct"))


def response_marks(facts: DataFrame) -> DataFrame:
    """For each platform, and (all): the share with a reply by each horizon, read off the curve at its last day up to then, and the first
    day by which half had one. Null where the curve begins later, or never comes down to half."""
    placed = facts.select("*", F.explode(F.array(F.col("platform"), F.lit("(all)"))).alias("of"))
    day, left = F.col("day"), F.col("still_waiting_pct")
    marks = [F.round(F.lit(100.0) - F.max_by(left, F.when(day <= h, day)), 2).alias(f"day_{h}") for h in HORIZONS]
    return curves(placed, F.col("of")).groupBy(F.col("key").alias("platform")).agg(*marks, F.min(F.when(left <= 50, day)).alias("median_day"), F.max("day").alias("last_day"))


def segment_verdicts(facts: DataFrame) -> DataFrame:
    """For each kind of segment: its best and worst one by response rate, of those with enough applications to tell, and whether intervals keep them apart.

    Ties go to more applications, then to the first name. separated: the best one's interval lies above the worst one's; beats_overall: above that of all applications.
    """
    kinds = {"(all)": F.lit("(all)")} | {k: F.col(c) for k, c in SEGMENTS.items()}
    pairs = [F.struct(F.lit(k).alias("dim"), c.alias("member")) for k, c in kinds.items()]
    counted = facts.select("is_response", F.inline(F.array(*pairs))).groupBy("dim", "member").agg(F.count(F.lit(1)).alias("n"), count_where("is_response").alias("x"))
    n, x = F.col("n"), F.col("x")
    rated = counted.withColumns({"rate": pct(x, n), "lo": wilson(x, n, False), "hi": wilson(x, n, True)})
    row = [n, "member", "rate", "lo", "hi"]
    best, worst = (F.min(F.struct(sign.alias("by"), (-n).alias("more"), *(F.col(c) if isinstance(c, str) else c for c in row[1:]), n)) for sign in (-F.col("rate"), F.col("rate")))
    enough = rated.where((n >= INDICATIVE) | (F.col("dim") == "(all)"))
    df = enough.groupBy("dim").agg(F.count(F.lit(1)).alias("members"), best.alias("best"), worst.alias("worst"))
    overall = F.max(F.when(F.col("dim") == "(all)", F.col("best.hi"))).over(Window.partitionBy())  # a row a kind
    out = df.select(
        "dim", "members", F.col("best.member").alias("best"), F.col("best.rate").alias("best_rate_pct"), F.col("worst.member").alias("worst"), F.col("worst.rate").alias("worst_rate_pct"),
        ((F.col("members") > 1) & (F.col("best.lo") > F.col("worst.hi"))).alias("separated"), (F.col("best.lo") > overall).alias("beats_overall"),
    )
    return out.where("dim <> '(all)'")


def fixed_levels(facts: DataFrame) -> DataFrame:
    """Each application with what is fixed for its company, platform and month, whatever else it is shown by.

    Each level is aggregated and joined back: no window, so that a company with very many applications is not one task's.
    """
    month = F.date_format("applied_date", "yyyy-MM")
    base = facts.select("application_id", "company_name", "platform", month.alias("cohort_month"), "applied_date", "is_response", "days_since_applied")
    rate = pct(count_where("is_response"), F.count(F.lit(1)))
    company = base.groupBy("company_name").agg(F.min("applied_date").alias("company_first_applied"), (F.count(F.lit(1)) > 1).alias("is_repeat_employer"))
    platform = base.groupBy("platform").agg(rate.alias("platform_response_rate_pct"), F.count(F.lit(1)).alias("platform_applications"))
    cohort = base.groupBy("cohort_month").agg(rate.alias("cohort_response_rate_pct"), (F.max("days_since_applied") < 30).alias("cohort_is_maturing"))
    df = base.join(company, "company_name").join(platform, "platform").join(cohort, "cohort_month")
    return df.drop("applied_date", "is_response", "days_since_applied", "company_name", "platform", "cohort_month")


def month_roles(facts: DataFrame, events: DataFrame) -> DataFrame:
    """The calendar in all its roles, a row a month: applications sent, replies that came, applications last touched, status changes."""
    dates = [F.struct(F.lit(r).alias("role"), F.col(d).alias("day")) for r, d in (("sent", "applied_date"), ("touched", "last_activity_date"))]
    replied = F.struct(F.lit("replies").alias("role"), F.when(F.col("is_response"), F.col("first_response_date")).alias("day"))
    days = facts.select(F.inline(F.array(*dates, replied))).unionByName(events.select(F.lit("changes").alias("role"), F.col("occurred_on").alias("day")))
    roles = ["sent", "replies", "touched", "changes"]
    return days.where("day IS NOT NULL").groupBy(F.date_format("day", "yyyy-MM").alias("month")).pivot("role", roles).count().na.fill(0)


def largest_drop(steps: DataFrame) -> DataFrame:
    """The step of a funnel at which most applications are lost; of equal ones the first."""
    lost = steps.where("lost_at_step IS NOT NULL")
    drop = F.min(F.struct((-F.col("lost_at_step")).alias("by"), "stage_order", "stage", "lost_at_step"))
    return lost.agg(drop.alias("d")).select("d.stage", "d.lost_at_step")


def one_in(rate: Column) -> Column:
    """A rate in percent in words: 1 in so many from 5 % on, below that the percentage; none without a rate."""
    many = F.concat(F.lit("1 in "), F.rint(F.lit(100.0) / rate).cast("int").cast("string"))
    return F.when(rate >= 5, many).when(rate.isNotNull(), F.concat(F.format_number(rate, 1), F.lit("%"))).otherwise("-")


def platform_words(rates: DataFrame) -> DataFrame:
    return rates.select("platform", "applications", one_in(F.col("response_rate_pct")).alias("replies"), one_in(F.col("interview_rate_pct")).alias("interviews"))
