"""Readers, and the driver's tables seen as a pipeline's raw tables.

Orders are items, their lines are status events. Raw tables hold text only, as extracts of an operational store do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domain import SOURCES, STATUSES

APPLICATION_SCHEMA = (
    "thread_id company_name role_title source_platform application_date current_status last_updated job_description_snippet job_url gmail_link "
    "latest_subject is_valid filter_reason job_type seniority_level industry notes role_family location salary_text parse_confidence parsed_by origin"
).split()
EVENT_SCHEMA = "event_id thread_id from_status to_status occurred_on recorded_at source message_id note".split()
#: Columns that never leave the operational store.
PRIVATE = ("body_text",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(df: DataFrame, excluded: tuple[str, ...] = PRIVATE) -> DataFrame:
    """A bronze copy: all columns as text, without the private ones."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns if c not in excluded))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def after_date(floor: str, watermark: str | F.Column, overlap_days: int = 2):
    """The day from which to read again: the floor, or two days before what was last seen."""
    return F.greatest(F.lit(floor).cast("date"), F.date_sub(F.to_date(watermark), overlap_days))


def status_of_line():
    """The status that a line stands for."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        F.when((flag == "R") & (status == "O"), F.when(F.col("l_discount") >= 0.08, "Offer").otherwise("Interview"))
        .when(flag == "R", "Rejected")
        .when((flag == "A") & (status == "F"), "Assessment / OA")
        .when(flag == "A", "Ghosted")
        .when(status == "F", "Withdrawn")
        .otherwise("Applied")
    )


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their status and the days from their order to them: enough to sort an order's lines without the order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_extendedprice")
    rank = F.create_map(*[F.lit(x) for s in STATUSES for x in (s[0], s[6])])
    df = lines.withColumns({"to_status": status_of_line(), "offset": (F.col("l_partkey") % 75 - 5).cast("int")})
    return df.withColumn("sort_order", rank[F.col("to_status")])


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """status_events as text: one for each line, its predecessor by date, status and the whole line."""
    w = Window.partitionBy("l_orderkey").orderBy("offset", "sort_order", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    kinds = F.array(*[F.lit(s) for s in SOURCES])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("applied"))
    df = placed_lines(spark, sf_dir).withColumns({"n": F.row_number().over(w), "before": F.lag("to_status").over(w)})
    df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("occurred", F.date_add("applied", F.col("offset")))
    return df.select(
        F.concat_ws("-", "l_orderkey", "n").alias("event_id"),
        F.col("l_orderkey").cast("string").alias("thread_id"),
        F.coalesce("before", F.lit("")).alias("from_status"),
        "to_status",
        F.concat(F.col("occurred").cast("string"), F.lit("T10:00:00")).alias("occurred_on"),
        F.col("occurred").cast("string").alias("recorded_at"),
        F.element_at(kinds, (F.col("l_suppkey") % 7 + 1).cast("int")).alias("source"),
        F.lit("").alias("message_id"),
        F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit(" part "), "l_partkey")).otherwise("").alias("note"),
    )


def by_rest(k, n: int, values: dict[int, str | None], other):
    """The value of a key's rest when divided by n."""
    out = other
    for rest, value in values.items():
        out = F.when(k % n == rest, F.lit(value)).otherwise(out)
    return out


def raw_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """applications as text: one for each order, in the state of its latest event.

    As in an operational store some are untidy, which a residue of the key decides: judged invalid, not judged, or judged
    in words; in statuses of older versions or only saved; without a date, or with one and a time; without attributes.
    """
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    last = placed_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.max(F.struct("offset", "sort_order", "to_status")).alias("s"))
    df = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")

    def pick(by, *values: str):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    return df.select(
        k.cast("string").alias("thread_id"),
        F.col("c_name").alias("company_name"),
        F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("Role "), (k % 50).cast("string"))).alias("role_title"),
        F.col("o_orderpriority").alias("source_platform"),
        F.when(k % 37 == 0, "").when(k % 2 == 0, F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T09:00:00"))).otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("application_date"),
        by_rest(k, 32, {5: "Screening/OA", 13: "Response", 21: "Ghosted/Inactive", 29: " Weird Legacy Status ", 10: "Saved / Planning", 26: ""}, F.coalesce("s.to_status", F.lit("Applied"))).alias("current_status"),
        F.when(k % 31 == 0, " ").otherwise(F.coalesce(F.date_add(F.col("o_orderdate").cast("date"), F.col("s.offset")).cast("string"), F.lit(""))).alias("last_updated"),
        F.when(k % 3 == 0, F.repeat(F.lit("description "), 4)).otherwise("short").alias("job_description_snippet"),
        F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("https://jobs.example/"), k.cast("string"))).alias("job_url"),
        F.concat(F.lit("https://mail.example/"), k.cast("string")).alias("gmail_link"),
        F.when(k % 4 == 0, F.concat(F.lit(" Re: order "), k.cast("string"))).otherwise("").alias("latest_subject"),
        by_rest(k, 16, {3: "", 7: "0.0", 11: "yes", 15: None}, F.lit("1.0")).alias("is_valid"),
        F.lit("").alias("filter_reason"),
        F.when(k % 25 != 0, pick(k, "Full Time", "Internship", "Contract")).alias("job_type"),
        F.when(k % 27 == 0, " ").otherwise(pick(F.col("o_custkey"), "Junior", "Mid", "Senior", "Lead")).alias("seniority_level"),
        F.when(k % 29 == 0, "").otherwise(F.col("c_mktsegment")).alias("industry"),
        F.when(k % 7 == 0, F.concat(F.lit("note "), (k % 3).cast("string"))).otherwise("").alias("notes"),
        F.col("n_name").alias("role_family"),
        pick(k, "Kuala Lumpur", "Penang", "Remote", "", "Johor").alias("location"),
        F.when(k % 9 == 0, F.concat((k % 90).cast("string"), F.lit(" k"))).otherwise("").alias("salary_text"),
        (k % 100 / F.lit(100.0)).cast("string").alias("parse_confidence"),
        pick(k, "rules", "llm").alias("parsed_by"),
        F.when(k % 20 == 0, "manual").otherwise("gmail").alias("origin"),
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """processed_messages as text: one for each labelled document, its quality as the verdict."""
    df, k = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), F.col("doc_id")
    return df.select(
        F.col("doc_id").cast("string").alias("message_id"),
        F.col("doc_id").cast("string").alias("thread_id"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("2001-07-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("message_date"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("subject "), (k % 10).cast("string"))).alias("subject"),
        F.concat(F.lit("sender"), (k % 7).cast("string"), F.lit("@mail.example")).alias("sender"),
        F.when(F.col("quality") == 1, "1.0").when(k % 11 == 0, "?").when(F.col("quality") == 0, "0.0").alias("is_valid"),
        F.when(F.col("quality") == 0, F.col("source")).otherwise("").alias("filter_reason"),
        F.when(k % 6 == 0, "Interview").otherwise("").alias("detected_status"),
        F.when(k % 3 == 0, "llm").when(k % 13 == 1, "").otherwise("rules").alias("parsed_by"),
        F.when(k % 17 != 0, (k % 100 / F.lit(100.0)).cast("string")).alias("confidence"),
    )
