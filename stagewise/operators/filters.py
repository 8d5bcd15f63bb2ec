"""The filter algebra that all metrics share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from datetime import date, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import FOLLOW_UP_AFTER

SEGMENTS = {"platform": "platform", "channel": "channel", "role_family": "role_family", "industry": "industry", "seniority": "seniority", "job_type": "job_type", "company": "company_name"}
MEMBERS = {
    "platforms": "platform",
    "statuses": "current_status",
    "role_families": "role_family",
    "industries": "industry",
    "job_types": "job_type",
    "companies": "company_name",
    "seniorities": "seniority",
    "channels": "channel",
}

# Named sets of applications, as conditions on the fact; {quiet} stands for the days without news.
SETS = {
    "response": "is_response",
    "no_response": "not is_response",
    "assessment": "reached_assessment",
    "interview": "reached_interview",
    "offer": "reached_offer",
    "rejected": "is_rejected",
    "ghosted": "is_ghosted",
    "active": "is_active",
    "awaiting": "is_active and max_stage_reached = 1",
    "in_progress": "is_active and max_stage_reached >= 2",
    "follow_up": "is_active and days_since_activity >= {quiet}",
    "dated_reply": "days_to_response is not null",
}
DRILL_SETS = list(SETS)


def in_sets(names: tuple[str, ...], quiet: int) -> Column:
    """Applications that are in all of the sets."""
    if unknown := set(names) - SETS.keys():
        raise ValueError(f"unknown sets {sorted(unknown)}")
    return reduce(Column.__and__, (F.expr(SETS[n].format(quiet=int(quiet))) for n in names))


def found(needle: str) -> Column:
    """Applications whose employer, role or place holds the needle, in any case; its wildcards count."""
    like = "%" + needle.replace("\\", "\\\\") + "%"
    return reduce(Column.__or__, (F.coalesce(c, F.lit("")).ilike(like) for c in ("company_name", "role_title", "location")))


#: What a filled field of a filter asks of an application, from its value and the days without news.
ASKS: dict[str, Callable[[Any, int], Column]] = {
    "month": lambda x, _: F.date_format("applied_date", "yyyy-MM") == x,
    "search": lambda x, _: found(x),
    "reached": lambda x, quiet: in_sets(x, quiet),
    "date_from": lambda x, _: F.col("applied_date") >= F.lit(x),
    "date_to": lambda x, _: F.col("applied_date") <= F.lit(x),
} | {name: (lambda x, _, column=column: F.col(column).isin(*x)) for name, column in MEMBERS.items()}


@dataclass(frozen=True)
class Filters:
    date_from: date | None = None
    date_to: date | None = None
    platforms: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    role_families: tuple[str, ...] = ()
    industries: tuple[str, ...] = ()
    job_types: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    seniorities: tuple[str, ...] = ()
    channels: tuple[str, ...] = ()
    search: str = ""
    reached: tuple[str, ...] = field(default=())
    month: str = ""

    def predicate(self, follow_up_days: int = FOLLOW_UP_AFTER) -> Column:
        """All that the filled fields ask for; blank text is not filled."""
        given = {f.name: v.strip() if isinstance(v := getattr(self, f.name), str) else v for f in fields(self)}
        return reduce(Column.__and__, (ask(given[name], follow_up_days) for name, ask in ASKS.items() if given[name]), F.lit(True))

    def apply(self, facts: DataFrame, follow_up_days: int = FOLLOW_UP_AFTER) -> DataFrame:
        return facts.where(self.predicate(follow_up_days))

    def to_dict(self) -> dict:
        return {k: v.isoformat() if isinstance(v, date) else list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if v}

    @classmethod
    def from_dict(cls, given: dict) -> Filters:
        dates = {k: date.fromisoformat(given[k]) for k in ("date_from", "date_to") if given.get(k)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()} | dates)

    @classmethod
    def preset(cls, name: str, today: date) -> Filters:
        starts = {"30d": today - timedelta(29), "90d": today - timedelta(89), "ytd": date(today.year, 1, 1), "all": None}
        return cls(date_from=starts[name], date_to=None if name == "all" else today)
