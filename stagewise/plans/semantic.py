"""What a dashboard's model asks of the star: pivots, other date roles, fixed levels of detail, ranks, bands, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domain import BANDS, STATUSES, inline
from ..functions.expr import count_where, pct
from ..operators.prefix import running

SENT = [s[0] for s in STATUSES if s[6] > 0]


def status_by_platform(facts: DataFrame) -> DataFrame:
    """Applications of each platform by status, a column each. The statuses are known, so one pass is enough."""
    return facts.groupBy("platform").pivot("current_status", SENT).count().na.fill(0)


def replies_by_month(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """The calendar in another role: months of the first reply, not of the application."""
    days = F.broadcast(calendar.select("date_day", "year_month"))  # a row a day
    replied = facts.join(days, F.col("first_response_date") == F.col("date_day"))
    return replied.groupBy(F.col("year_month").alias("reply_month")).agg(F.count(F.lit(1)).alias("replies"), count_where("reached_interview").alias("interviews"))


def industry_detail(facts: DataFrame) -> DataFrame:
    """For each industry what it holds on the level of its companies, and its share of all applications."""
    by_company = facts.groupBy("industry", "company_name").agg(F.count(F.lit(1)).alias("n"))
    df = by_company.groupBy("industry").agg(F.count(F.lit(1)).alias("companies"), F.sum("n").alias("applications"), F.max("n").alias("most_of_a_company"))
    everyone = F.sum("applications").over(Window.partitionBy())  # a row an industry
    return df.select("*", F.round(F.col("applications") / F.col("companies"), 2).alias("applications_per_company"), pct(F.col("applications"), everyone).alias("share_pct"))


def company_ranks(facts: DataFrame) -> DataFrame:
    """All companies by the number of their applications, ranked without gaps, with the running sum: by ranges, so that no task gets all companies."""
    df = facts.groupBy("company_name").agg(F.count(F.lit(1)).alias("applications"))
    levels = df.select("applications").distinct()  # as many as there are different numbers: few, since they add up to the applications
    ranks = levels.select(F.col("applications").alias("level"), F.dense_rank().over(Window.orderBy(F.desc("applications"))).alias("rank"))
    summed = running(df, [F.desc("applications"), F.col("company_name")], {"running": F.col("applications")})
    return summed.join(ranks, F.col("applications") == F.col("level")).select("company_name", "applications", "rank", "running")


def platform_bands(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """Each platform's response rate and the band with the largest floor that it reaches: a lookup as of a value."""
    bands = F.broadcast(inline(spark, BANDS, "band", "floor"))
    rates = facts.groupBy("platform").agg(pct(count_where("is_response"), F.count(F.lit(1))).alias("response_rate_pct"))
    return rates.join(bands, F.col("floor") <= F.col("response_rate_pct"), "left").groupBy("platform", "response_rate_pct").agg(F.max_by("band", "floor").alias("band"))


def events_to_archive(events: DataFrame, newest: int = 3) -> DataFrame:
    """Events that are not among an application's newest."""
    w = Window.partitionBy("application_id").orderBy(F.desc("occurred_on"), F.desc("event_id"))
    return events.withColumn("age", F.row_number().over(w)).where(F.col("age") > newest).select("application_id", "event_id", F.col("age").cast("long").alias("age"))


def evaluation(messages: DataFrame) -> DataFrame:
    """How well a found status tells application mail, by reader: the confusion matrix, precision, recall and F1 in percent."""
    real, found = F.col("is_application_mail"), F.col("detected_status").isNotNull()
    cells = {"tp": real & found, "fp": ~real & found, "fn": real & ~found, "tn": ~real & ~found}
    df = messages.groupBy("parsed_by").agg(*(count_where(c).alias(n) for n, c in cells.items()))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return df.select("*", pct(tp, tp + fp).alias("precision_pct"), pct(tp, tp + fn).alias("recall_pct"), pct(2 * tp, 2 * tp + fp + fn).alias("f1_pct"))
