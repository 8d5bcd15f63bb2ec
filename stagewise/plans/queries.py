"""The warehouse's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links, text
from ..operators import fold, merge, store
from ..operators import postings as job_postings
from ..operators.filters import DRILL_SETS, SEGMENTS, Filters
from ..session import removed, scratch, stash
from ..sources import job_pages, mail, tables
from ..streaming import retries
from . import checks, derived, evaluation, export, measures, models, semantic, threads, upkeep
from .build import Frames, publish, read_published
from .metrics import Metrics

AS_OF = date(2001, 8, 2)
FILTER = Filters(date_from=date(1996, 1, 1), date_to=date(2000, 12, 31), platforms=("1-URGENT", "3-MEDIUM"), search="7")
Query = Callable[[SparkSession, str], DataFrame]


#: Models that are built once in a session and then read: what most queries begin with.
KEPT = frozenset("stg_applications stg_status_events fct_applications fct_status_events dim_date dim_platform".split())
#: What they are made from.
INPUTS = tuple("orders lineitem customer nation documents labels".split())
#: Folders of builds, by application, tables' folder, state of the tables' files, and model.
BUILDS: dict[tuple[str, str, str, str], str] = {}


def state_of(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = INPUTS) -> str:
    """Changes when a file of the tables is added, removed or replaced: by paths, sizes and times. No file is read, and the driver gets one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{sf_dir}/{n}.parquet" for n in names])
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    return str(tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"), F.sum(mark)).first()))


class Star(Frames):
    """Frames over one folder of tables. Models that are kept are published when first asked for, and read from there by all queries of the session, as long as the tables' files are the same."""

    def __init__(self, spark: SparkSession, sf_dir: str, kept: frozenset[str]) -> None:
        readers = {f.__name__: partial(f, spark, sf_dir) for f in (tables.raw_applications, tables.raw_events, tables.raw_messages)}
        super().__init__(models.seeds(spark) | {"as_of": AS_OF}, readers)
        self.spark, self.sf_dir, self.kept = spark, sf_dir, kept

    @cached_property
    def state(self) -> str:
        return state_of(self.spark, self.sf_dir)

    def __missing__(self, name: str):
        if name not in self.kept:
            return super().__missing__(name)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.state, name)
        if key not in BUILDS:
            folder = scratch(self.spark, f"star-{name}")
            publish(self.spark, {name: super().__missing__(name)}, folder)
            BUILDS[key] = folder
        self[name] = read_published(self.spark, BUILDS[key], name)
        return self[name]


def frames(spark: SparkSession, sf_dir: str, kept: frozenset[str] = KEPT) -> Frames:
    return Star(spark, sf_dir, kept)


def rebuild(spark: SparkSession, sf_dir: str) -> None:
    """Remove what was built over a folder; frames that still read it end with it."""
    for key in [k for k in BUILDS if k[1] == sf_dir]:
        removed(spark, BUILDS.pop(key))


def metric(name: str, segment: str = "industry", filters: Filters | None = None) -> Query:
    return lambda spark, sf_dir: Metrics(frames(spark, sf_dir), AS_OF, filters).query(name, segment)


def of_model(name: str) -> Query:
    return lambda spark, sf_dir: frames(spark, sf_dir)[name]


def drill(name: str) -> Query:
    return lambda spark, sf_dir: Filters(reached=(name,)).apply(of_model("fct_applications")(spark, sf_dir)).select("application_id", "company_name", "current_status", "applied_date")


def rpt_flat_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = of_model("rpt_flat")(spark, sf_dir)
    return flat.groupBy(F.col("applied_month").alias("applied_year_month"), F.col("applied_weekday").alias("applied_day_of_week"), "channel").agg(F.count(F.lit(1)).alias("applications"), F.sum("event_count").alias("events"))


def data_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tests over one build, which is published, so that nothing is made twice."""
    return checks.data_tests(frames(spark, sf_dir, KEPT | frozenset(checks.KEYS)))


def third(applications: DataFrame) -> DataFrame:
    return applications.where(F.col("thread_id").cast("long") % 3 == 0)


def postings(applications: DataFrame) -> DataFrame:
    """What postings told about some of the applications."""
    k = F.col("thread_id").cast("long")
    found = applications.where((k % 5).isin(1, 3)).select("thread_id", (k % 5 == 3).alias("ok"))
    return found.select("*", F.lit("Analyst").alias("title"), F.repeat(F.lit("posting "), 8).alias("description"), F.lit("Ipoh").alias("location"), F.lit("").alias("salary"))


def read_again(messages: DataFrame) -> DataFrame:
    """Messages with even ids as they are read a second time: a status is found, and dates of some are not given."""
    k = F.col("message_id").cast("long")
    again = messages.where(k % 2 == 0).withColumn("detected_status", F.lit("Offer"))
    return again.withColumn("message_date", F.when(k % 3 == 0, "").otherwise("2001-08-01"))


STORE = {
    "store_ghosting": lambda f: store.ghosted(f["raw_applications"], AS_OF)[1],
    "store_last_changes": lambda f: store.last_changes(f["raw_events"]).select("thread_id", "event_id", "from_status", "to_status"),
    "store_undo": lambda f: store.undone(f["raw_applications"], f["raw_events"], third(f["raw_applications"]))[0].select("thread_id", "current_status", "last_updated"),
    "store_upsert": lambda f: store.upserted(f["raw_messages"], read_again(f["raw_messages"]), "message_id", ("message_date",)).select("message_id", "message_date", "detected_status", "sender"),
    "store_enrichment": lambda f: store.enriched(f["raw_applications"], postings(f["raw_applications"])).select("thread_id", "job_description_snippet", "location", "salary_text"),
    "store_to_enrich": lambda f: store.to_enrich(f["raw_applications"]),
    "store_review_queue": lambda f: store.review_queue(f["raw_applications"]),
    "store_noise": lambda f: store.noise(f["raw_applications"]),
    "store_changes": lambda f: store.changes_since(f["raw_applications"], f["raw_events"], "2001-07-01").select("thread_id", "event_id", "is_new"),
    "store_counts": lambda f: store.counts(f["raw_applications"], f["raw_messages"]),
}


def as_messages(events: DataFrame) -> DataFrame:
    """The events as messages: what they say, unless that comes of no message; those that were inferred are not valid."""
    said = F.when(~F.col("to_status").isin("Ghosted", "Withdrawn"), F.col("to_status")).alias("detected_status")
    day = F.substring("occurred_on", 1, 10).alias("day")
    return events.select("thread_id", F.col("event_id").alias("message_id"), day, (F.col("source") != "inferred").alias("is_valid"), said, F.trim("note").alias("subject"), (F.length("note") / F.lit(10.0)).alias("confidence"))


MERGE = {
    "merge_threads": lambda f: merge.threads(as_messages(f["raw_events"])),
    "merge_events": lambda f: merge.status_events(as_messages(f["raw_events"])),
}
SEMANTIC = {
    "status_by_platform": lambda f: semantic.status_by_platform(f["fct_applications"]),
    "replies_by_month": lambda f: semantic.replies_by_month(f["fct_applications"], f["dim_date"]),
    "industry_detail": lambda f: semantic.industry_detail(f["fct_applications"]),
    "company_ranks": lambda f: semantic.company_ranks(f["fct_applications"]),
    "platform_bands": lambda f: semantic.platform_bands(f.spark, f["fct_applications"]),
    "events_to_archive": lambda f: semantic.events_to_archive(f["fct_status_events"]),
    "evaluation": lambda f: semantic.evaluation(f["stg_messages"]),
    "rpt_flat": lambda f: f["rpt_flat"],
}


DERIVED = {
    "measures": lambda f: measures.measures(f["fct_applications"]),
    "measure_parity": lambda f: measures.parity(f["fct_applications"], AS_OF),
    "response_marks": lambda f: derived.response_marks(f["fct_applications"]),
    "segment_verdicts": lambda f: derived.segment_verdicts(f["fct_applications"]),
    "fixed_levels": lambda f: derived.fixed_levels(f["fct_applications"]),
    "month_roles": lambda f: derived.month_roles(f["fct_applications"], f["fct_status_events"]),
    "largest_drop": lambda f: derived.largest_drop(Metrics(f, AS_OF).query("funnel")),
    "platform_words": lambda f: derived.platform_words(Metrics(f, AS_OF).query("platform_performance")),
    "star_csv": lambda f: export.exported(f, scratch(f.spark, "export")),
}


def of_store(name: str) -> Query:
    return lambda spark, sf_dir: (STORE | MERGE | SEMANTIC | DERIVED | upkeep.STORE)[name](frames(spark, sf_dir))


def text_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_line = text.sanitized("text")
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(one_line).alias("chars"), F.md5(one_line).alias("digest"))


def text_job_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = text.labelled("text", text.JOB_TYPES, text.JOB_TYPE).alias("job_type")
    return tables.table(spark, sf_dir, "documents").groupBy(label).agg(F.count(F.lit(1)).alias("documents"))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = text.stripped_html("html")
    pages = tables.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.length(said).alias("chars"), F.md5(said).alias("digest"), text.page_title("html").alias("title"), F.size(text.links("html")).alias("links"), text.host("url").alias("host"), text.without_parameters("url").alias("url"))


EVENTS = ("Applied", "Assessment / OA", "Interview", "Offer", "Rejected")


def cells(read: DataFrame) -> DataFrame:
    return evaluation.confusion(evaluation.judged_rows(read, EVENTS))


#: Queries over mail as it is read.
MAIL: dict[str, Callable[[DataFrame], DataFrame]] = {
    "mail_bodies": lambda read: read.select("message_id", F.length("snippet").alias("chars"), F.md5("snippet").alias("digest")),
    "mail_verdicts": lambda read: read.select("message_id", "verdict.*"),
    "mail_tiers": lambda read: read.groupBy("verdict.tier", "verdict.reason").agg(F.count(F.lit(1)).alias("messages")),
    "mail_statuses": lambda read: read.select("message_id", "detected_status", "is_ambiguous"),
    "mail_labels": lambda read: read.groupBy("job_type", "seniority", "industry", "role_family").agg(F.count(F.lit(1)).alias("messages")),
    "evaluation_confusion": cells,
    "evaluation_by_class": lambda read: evaluation.scores(cells(read)),
    "evaluation_gate": lambda read: evaluation.gate(cells(read)),
    "mail_links": lambda read: read.select("message_id", links.best_link("body").alias("link")).select("message_id", "link.url", "link.score"),
    "mail_employers": lambda read: evaluation.employers(read).drop("truth_name"),
    "evaluation_employers": lambda read: evaluation.named(evaluation.employers(read)),
    "repair_plan": lambda read: upkeep.repairs(read, EVENTS),
    "repaired_rows": lambda read: upkeep.repaired_rows(read, EVENTS),
    "review_plan": upkeep.review_plan,
    "review_results": lambda read: upkeep.review_results(read, EVENTS),
    "thread_states": lambda read: fold.states(threads.folded(read, AS_OF)),
    "thread_events": lambda read: fold.events(threads.folded(read, AS_OF)),
}


#: Of messages as they are read, what queries use that use it more than once, or filter by it: that is written first, so that no message is read again for each condition; the rest is not made.
REPAIRED = "message_id k truth verdict detected_status job_type industry".split()
REVIEWED = "message_id k truth arrived chars is_ambiguous".split()
READ_ONCE = {"repair_plan": REPAIRED, "repaired_rows": REPAIRED, "review_plan": REVIEWED, "review_results": [*REVIEWED, "verdict", "detected_status"]}


def of_mail(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = evaluation.read(mail.mail(spark, sf_dir))
        return MAIL[name](stash(read.withColumn("chars", F.length("snippet")).select(READ_ONCE[name]), "mail") if name in READ_ONCE else read)

    return run


def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_postings.extracted(job_pages.job_pages(spark, sf_dir))


def first_seen_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the order in which three listings of orders name them: urgent ones, open ones, all."""
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), "o_orderpriority", "o_orderstatus")
    listings = F.array(F.when(F.col("o_orderpriority") == "1-URGENT", 1), F.when(F.col("o_orderstatus") == "O", 2), F.lit(3))
    return retries.first_seen(orders.select(F.explode(F.array_compact(listings)).alias("listing"), F.col("o_orderkey").alias("position"), "id"))


METRICS = "kpis period_compare funnel sankey weekly_velocity monthly_cohorts platform_performance response_survival response_time_buckets weekday_performance activity_calendar status_mix stage_timing company_leaderboard follow_up_queue transitions recent_activity data_quality applications parser_quality filter_options date_bounds".split()
MODELS = "milestones fct_applications fct_status_events dim_date dim_company dim_industry dim_job_type dim_role_family dim_seniority dim_platform dim_status".split()


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {n: metric(n) for n in METRICS}
    found["kpis_filtered"] = metric("kpis", filters=FILTER)
    found |= {f"segment_{s}": metric("segment_performance", s) for s in SEGMENTS}
    found |= {n: of_model(n) for n in (*MODELS, "stg_applications", "stg_messages")} | {"stg_events": of_model("stg_status_events"), "rpt_flat_months": rpt_flat_months, "data_tests": data_tests}
    found |= {n: of_store(n) for n in (*STORE, *MERGE, *SEMANTIC, *DERIVED, *upkeep.STORE)} | {f.__name__: f for f in (text_messages, text_job_types, html_pages, page_postings, first_seen_customers)}
    found |= {n: of_mail(n) for n in MAIL}
    return found | {f"drill_{n}": drill(n) for n in DRILL_SETS}
