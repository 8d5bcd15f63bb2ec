"""Measures: each is defined once, as a small tree over aggregates, and compiled both to Columns and to SQL text.

A surface says whose applications a measure is taken over: all, one of the named sets, a platform, a month of the
application, or a month in one of the calendar's other roles (first reply, last activity). All measures of all surfaces
come from one aggregation: an application gives a row for each member it belongs to. parity holds the two compilations and the metric of the same
name against each other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import DIRECT_INTERVIEW_PCT, FOLLOW_UP_AFTER, Z
from ..operators.filters import SETS, Filters

#: How far a measure and a metric, which is rounded to one digit, may be apart.
TOLERANCE = 0.051
DIGITS = 4


class Node:
    """A measure, or a part of one. Aggregates are leaves; all else is made of them."""

    def __add__(self, other: Node) -> Op:
        return Op("+", self, other)

    def __sub__(self, other: Node) -> Op:
        return Op("-", self, other)

    def __mul__(self, other: Node) -> Op:
        return Op("*", self, other)

    def __truediv__(self, other: Node) -> Op:
        """Null where the other is 0."""
        return Op("/", self, other)


@dataclass(frozen=True)
class Leaf(Node):
    """count: of the rows that meet a condition; known: of values; distinct, mean, median."""

    kind: str
    of: str

    def column(self) -> Column:
        made = {"count": lambda x: F.count_if(F.coalesce(x, F.lit(False))), "known": F.count, "distinct": F.count_distinct, "mean": F.avg, "median": F.median}
        return made[self.kind](F.expr(self.of)).cast("double")

    def sql(self) -> str:
        made = {"count": "count(CASE WHEN {} THEN 1 END)", "known": "count({})", "distinct": "count(DISTINCT {})", "mean": "avg({})", "median": "median({})"}
        return f"CAST({made[self.kind].format(self.of)} AS DOUBLE)"


@dataclass(frozen=True)
class Number(Node):
    value: float


@dataclass(frozen=True)
class Op(Node):
    sign: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Overall(Node):
    """What an aggregate is over all applications, whatever the surface."""

    leaf: Leaf


@dataclass(frozen=True)
class Root(Node):
    of: Node


@dataclass(frozen=True)
class Within(Node):
    """The value, not below 0 and not above 1."""

    of: Node


def count(condition: str) -> Leaf:
    return Leaf("count", condition)


def percent(x: Node, n: Node) -> Node:
    return Number(100.0) * x / n


def bound(x: Node, n: Node, upper: bool) -> Node:
    """A bound, in percent, of the 95 % Wilson score interval."""
    p, z2 = x / n, Number(Z * Z)
    half = Number(Z) * Root(p * (Number(1.0) - p) / n + z2 / (Number(4.0) * n * n))
    centre = p + z2 / (Number(2.0) * n)
    return Number(100.0) * Within((centre + half if upper else centre - half) / (Number(1.0) + z2 / n))


N, REPLIES, TALKS, OFFERS, TESTS = count("true"), count("is_response"), count("reached_interview"), count("reached_offer"), count("reached_assessment")
LAST, PREV = "days_since_applied < 30", "days_since_applied >= 30 AND days_since_applied < 60"
OVERALL = percent(Overall(REPLIES), Overall(N))

MEASURES: dict[str, Node] = {
    "applications": N,
    "companies": Leaf("distinct", "company_name"),
    "active": count("is_active"),
    "direct_share_pct": percent(count("is_direct"), N),
    "last_30": count(LAST),
    "prev_30": count(PREV),
    "change": count(LAST) - count(PREV),
    "change_pct": percent(count(LAST) - count(PREV), count(PREV)),
    "responses": REPLIES,
    "assessments": TESTS,
    "interviews": TALKS,
    "offers": OFFERS,
    "rejections": count("is_rejected"),
    "ghosted": count("is_ghosted"),
    "response_rate_pct": percent(REPLIES, N),
    "interview_rate_pct": percent(TALKS, N),
    "offer_rate_pct": percent(OFFERS, N),
    "rejection_rate_pct": percent(count("is_rejected"), N),
    "ghost_rate_pct": percent(count("is_ghosted"), N),
    "assessment_step_pct": percent(TESTS, REPLIES),
    "interview_step_pct": percent(TALKS, TESTS),
    "offer_step_pct": percent(OFFERS, TALKS),
    "response_rate_lo": bound(REPLIES, N, False),
    "response_rate_hi": bound(REPLIES, N, True),
    "interview_rate_lo": bound(TALKS, N, False),
    "interview_rate_hi": bound(TALKS, N, True),
    "median_days_to_response": Leaf("median", "days_to_response"),
    "avg_days_to_response": Leaf("mean", "days_to_response"),
    "responses_with_known_date": Leaf("known", "days_to_response"),
    "median_days_to_interview": Leaf("median", "days_to_interview"),
    "needs_follow_up": count(f"is_active AND days_since_activity >= {FOLLOW_UP_AFTER}"),
    "last_30_response_pct": percent(count(f"is_response AND {LAST}"), count(LAST)),
    "prev_30_response_pct": percent(count(f"is_response AND {PREV}"), count(PREV)),
    "overall_response_rate_pct": OVERALL,
    "response_vs_overall_pp": percent(REPLIES, N) - OVERALL,
    "vs_direct_benchmark_pp": percent(TALKS, N) - Number(DIRECT_INTERVIEW_PCT),
}


def leaves(node: Node) -> list[Leaf]:
    if isinstance(node, Leaf):
        return [node]
    parts = {Op: ("left", "right"), Overall: ("leaf",), Root: ("of",), Within: ("of",)}.get(type(node), ())
    return [x for p in parts for x in leaves(getattr(node, p))]


def named_leaves() -> dict[Leaf, str]:
    """The aggregates that the measures are made of, each once."""
    return {leaf: f"leaf_{i}" for i, leaf in enumerate(dict.fromkeys(x for m in MEASURES.values() for x in leaves(m)))}


def column(node: Node, names: dict[Leaf, str]) -> Column:
    """The node over columns that hold the aggregates."""
    match node:
        case Leaf():
            return F.col(names[node])
        case Number(value):
            return F.lit(value)
        case Overall(leaf):
            return F.max(F.when(F.col("surface") == "all", F.col(names[leaf]))).over(Window.partitionBy())  # a row a member
        case Root(of):
            return F.sqrt(column(of, names))
        case Within(of):
            x = column(of, names)
            return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
        case Op(sign, left, right):
            a, b = column(left, names), column(right, names)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / F.nullif(b, F.lit(0.0))}[sign]
    raise TypeError(f"not a measure: {node}")


def sql(node: Node, names: dict[Leaf, str]) -> str:
    """The same in SQL that Spark and others read."""
    match node:
        case Leaf():
            return names[node]
        case Number(value):
            return f"CAST({value!r} AS DOUBLE)"
        case Overall(leaf):
            return f"max(CASE WHEN surface = 'all' THEN {names[leaf]} END) OVER ()"
        case Root(of):
            return f"sqrt({sql(of, names)})"
        case Within(of):
            x = sql(of, names)
            return f"CASE WHEN {x} < 0 THEN CAST(0 AS DOUBLE) WHEN {x} > 1 THEN CAST(1 AS DOUBLE) ELSE {x} END"
        case Op(sign, left, right):
            b = sql(right, names)
            return f"({sql(left, names)} {sign} {f'nullif({b}, 0)' if sign == '/' else b})"
    raise TypeError(f"not a measure: {node}")


def by_text(source: str) -> str:
    """SQL for (surface, member, a column for each measure) over a relation of applications with surface and member."""
    names = named_leaves()
    aggregates = ", ".join(f"{leaf.sql()} AS {name}" for leaf, name in names.items())
    values = ", ".join(f"round({sql(m, names)}, {DIGITS}) AS {n}" for n, m in MEASURES.items())
    return f"SELECT surface, member, {values} FROM (SELECT surface, member, {aggregates} FROM {source} GROUP BY surface, member) AS aggregated"


def by_company(facts: DataFrame) -> DataFrame:
    """Facts dealt out by company before they are placed on surfaces, since companies are counted once: a task has all of a company's rows, so that no row of
    (surface, member, company), with the medians so far, goes from task to task."""
    return facts.repartition("company_name")


def on_surfaces(facts: DataFrame, quiet: int = FOLLOW_UP_AFTER) -> DataFrame:
    """A row for each application and member it belongs to: at most one a named set and four more, whatever the data."""
    def at(surface: str, member: Column | str, condition: Column | None = None) -> Column:
        m = F.lit(member) if isinstance(member, str) else member
        return F.when(m.isNotNull() if condition is None else condition, F.struct(F.lit(surface).alias("surface"), m.alias("member")))

    month = {f"{role}month": F.date_format(c, "yyyy-MM") for role, c in (("", "applied_date"), ("reply_", "first_response_date"), ("activity_", "last_activity_date"))}
    members = [at("all", "all"), at("platform", F.col("platform")), *(at(s, m) for s, m in month.items()), *(at("set", n, F.expr(c.format(quiet=int(quiet)))) for n, c in SETS.items())]
    return facts.select("*", F.inline(F.array_compact(F.array(*members))))


def by_columns(placed: DataFrame) -> DataFrame:
    """(surface, member, a column for each measure): one aggregation, then what is made of its columns."""
    names = named_leaves()
    made = placed.groupBy("surface", "member").agg(*(leaf.column().alias(n) for leaf, n in names.items()))
    return made.select("surface", "member", *(F.round(column(m, names), DIGITS).alias(n) for n, m in MEASURES.items()))


def long(wide: DataFrame, value: str, columns: list[str] | None = None) -> DataFrame:
    names = columns or list(MEASURES)
    return wide.select("surface", "member", *(F.col(n).cast("double").alias(n) for n in names)).unpivot(["surface", "member"], names, "measure", value)


def measures(facts: DataFrame) -> DataFrame:
    """(surface, member, measure, value) of all measures on all surfaces."""
    return long(by_columns(on_surfaces(by_company(facts))), "value")


def twins(facts: DataFrame, as_of) -> DataFrame:
    """(surface, member, measure, by_metric): the metrics that measure the same, each computed by its own code."""
    from . import metrics

    def of(df: DataFrame, surface: str, member: Column) -> DataFrame:
        placed = df.withColumns({"surface": F.lit(surface), "member": member})
        return long(placed, "by_metric", [c for c in df.columns if c in MEASURES])

    found = [of(metrics.kpis(facts), "all", F.lit("all")), of(metrics.period_compare(facts, as_of), "all", F.lit("all"))]
    found += [of(metrics.kpis(Filters(reached=(n,)).apply(facts)), "set", F.lit(n)) for n in SETS]
    found += [of(metrics.platform_performance(facts), "platform", F.col("platform"))]
    cohorts = metrics.monthly_cohorts(facts).withColumnRenamed("rejected", "rejections")
    found += [of(cohorts, "month", F.col("cohort_month"))]
    return reduce(DataFrame.unionByName, found)


def parity(facts: DataFrame, as_of) -> DataFrame:
    """(surface, member, measure, by_columns, by_sql, by_metric, agree) of every measure and member.

    agree: the two compilations differ by less than the rounding, and the metric, where there is one, by at most TOLERANCE;
    null meets null. A set without applications is on no surface; its metrics have no measure to meet.
    """
    placed = on_surfaces(by_company(facts))
    text = facts.sparkSession.sql(by_text("{placed}"), placed=placed)
    both = long(by_columns(placed), "by_columns").join(long(text, "by_sql"), ["surface", "member", "measure"])
    metric = twins(facts, as_of).withColumn("has_metric", F.lit(True))
    df = both.join(metric, ["surface", "member", "measure"], "left")

    def near(a: str, b: str, most: float) -> Column:
        return F.coalesce(F.abs(F.col(a) - F.col(b)) <= most, F.col(a).isNull() & F.col(b).isNull())

    agree = near("by_columns", "by_sql", 10.0**-DIGITS) & (F.col("has_metric").isNull() | near("by_columns", "by_metric", TOLERANCE))
    return df.select("surface", "member", "measure", "by_columns", "by_sql", "by_metric", agree.alias("agree"))
