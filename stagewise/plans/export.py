"""The star as CSV with a manifest, and the metrics as a report in Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..domain import BOARD_INTERVIEW_PCT, DIRECT_INTERVIEW_PCT
from . import derived
from .metrics import Metrics

#: Tables of the export, and what their rows are told apart by.
STAR = {
    "fct_applications": "application_id",
    "fct_status_events": "event_id",
    "dim_date": "date_key",
    "dim_platform": "platform_key",
    "dim_company": "company_key",
    "dim_industry": "industry_key",
    "dim_job_type": "job_type_key",
    "dim_role_family": "role_family_key",
    "dim_seniority": "seniority_key",
    "dim_status": "status_key",
    "rpt_flat": "application_id",
}
#: Quotes are doubled, a backslash is a character like any other, blanks and line ends inside texts stay; an empty text and none are both written as nothing, and read as none.
CSV = {"header": True, "escape": '"', "quote": '"', "dateFormat": "yyyy-MM-dd", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Files are packed by gzip: plain, the export of a large store takes ten times the tables it comes from.
WRITTEN, READ = CSV | {"emptyValue": "", "compression": "gzip"}, CSV | {"multiLine": True, "mode": "FAILFAST"}


def export_star(frames: dict, folder: str, names: dict[str, str] | None = None) -> None:
    """Write each table as a folder of CSV files, sorted by its key across files, and then the manifest: names, keys, columns with types.

    Files are as many as Spark deals the table out in; the manifest comes last, so what it names is whole.
    """
    entries = []
    for name, key in (names or STAR).items():
        df: DataFrame = frames[name]
        df.orderBy(key).write.options(**WRITTEN).csv(f"{folder}/star_schema/{name}")
        entries.append({"table": name, "key": key, "schema": df.schema.jsonValue()})
    spark = frames[next(iter(names or STAR))].sparkSession
    spark.createDataFrame([(json.dumps(e),) for e in entries], "value string").coalesce(1).write.text(f"{folder}/manifest")


def read_star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an export, with the types they had."""
    entries = [json.loads(r[0]) for r in spark.read.text(f"{folder}/manifest").collect()]  # a row a table
    return {e["table"]: spark.read.options(**READ).schema(StructType.fromJson(e["schema"])).csv(f"{folder}/star_schema/{e['table']}") for e in entries}


def cell(x) -> str:
    return "–" if x is None else f"{x:.1f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")


def table(df: DataFrame, titles: dict[str, str]) -> list[str]:
    """A frame of few rows, which the report shows in full."""
    rows = df.select(*titles).collect()
    return ["| " + " | ".join(titles.values()) + " |", "|" + "-|" * len(titles), *("| " + " | ".join(cell(x) for x in r) + " |" for r in rows), ""]


def report(metrics: Metrics, follow_ups: int = 15) -> str:
    """The report: headline, funnel, channels, waiting, months, and the follow_ups that have waited longest. Only aggregates, a row a segment or month, come to the driver."""
    k = metrics.query("kpis").first()
    lines = ["# Applications", ""]
    if not k["applications"]:
        return "\n".join([*lines, "No applications.", ""])
    lines += [f"{k['applications']} applications to {k['companies']} employers, {k['first_applied']} to {k['last_applied']}; {cell(k['response_rate_pct'])} % had a reply "
              f"(95 % interval {cell(k['response_rate_lo'])} to {cell(k['response_rate_hi'])}): {k['response_band']}.", ""]
    steps = metrics.query("funnel")
    lines += ["## Where applications stop", "", *table(steps, {"stage": "Stage", "applications": "Applications", "pct_of_applied": "% of applied", "step_conversion_pct": "Step %", "vs_benchmark": "Benchmark"})]
    drop = derived.largest_drop(steps).first()
    if drop["stage"]:
        lines += [f"Most are lost before **{drop['stage']}**: {drop['lost_at_step']}.", ""]
    lines += ["## Channels", "", *table(metrics.query("platform_performance"), {"platform": "Platform", "applications": "Applications", "response_rate_pct": "Replies %", "response_rate_lo": "from", "response_rate_hi": "to", "interview_rate_pct": "Interviews %", "sample_confidence": "Sample"})]
    verdict = derived.segment_verdicts(metrics.base).where("dim = 'platform' AND members > 1").first()
    if verdict:
        apart = "their intervals do not meet" if verdict["separated"] else "their intervals meet, so this may be chance"
        lines += [f"**{verdict['best']}** is answered most ({cell(verdict['best_rate_pct'])} %), **{verdict['worst']}** least ({cell(verdict['worst_rate_pct'])} %); {apart}.", ""]
    lines += [f"Published interview rates: {DIRECT_INTERVIEW_PCT} % of direct applications, {BOARD_INTERVIEW_PCT} % through job boards.", ""]
    marks = derived.response_marks(metrics.base)
    lines += ["## Waiting", "", *table(marks.orderBy("platform"), {"platform": "Platform", **{f"day_{h}": f"by day {h}, %" for h in derived.HORIZONS}, "median_day": "half by day"})]
    lines += ["## Months", "", *table(metrics.query("monthly_cohorts"), {"cohort_month": "Month", "applications": "Applications", "response_rate_pct": "Replies %", "interview_rate_pct": "Interviews %", "still_open": "Open"})]
    waiting = metrics.query("follow_up_queue").limit(follow_ups)
    return "\n".join([*lines, "## Follow up", "", *table(waiting, {"company_name": "Employer", "role_title": "Role", "days_since_activity": "Days", "suggested_action": "Next"})])


def exported(frames: dict, folder: str) -> DataFrame:
    """Export, read back, and count: table, rows, known (values that are not null), keys."""
    spark = frames["fct_applications"].sparkSession
    export_star(frames, folder)
    out = None
    for name, df in read_star(spark, folder).items():
        known = sum((F.count(F.col(c)) for c in df.columns[1:]), F.count(F.col(df.columns[0])))
        row = df.agg(F.count(F.lit(1)).alias("rows"), known.alias("known"), F.count_distinct(STAR[name]).alias("keys")).select(F.lit(name).alias("table"), "rows", "known", "keys")
        out = row if out is None else out.unionByName(row)
    return out
