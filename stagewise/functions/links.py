"""The link of a text that most looks like a posting: every link is scored with the words before it, in one pass over the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col
from .text import without_parameters

LINK = r"https?://[^\s<>\"')\]]+"
#: Characters before a link in which words about it are looked for.
WINDOW = 120
#: What speaks for a link, by points, and against it: words before it, its host, its path; and what no posting is.
CONTEXT, CONTEXT_POINTS = r"\bview (?:the|this|your) (?:job|role|posting|application)\b|\bapply (?:now|here|online|or)\b|\bthe posting\b", 4
HOST, HOST_POINTS = r"//(?:[\w-]+\.)*(?:ats|board)\.", 3
PATH, PATH_POINTS = r"job|apply|position|careers?|posting|vacanc", 2
EXCLUDED, EXCLUDED_POINTS = r"unsubscribe|privacy|//social\.|//img\.|/share/|\.(?:png|jpe?g|gif|svg)(?:[?#]|$)", -10
TRAILING = r"[.,;:)!?]+$"


def score(link: Column, before: Column) -> Column:
    """Points of a link, in lower case, after these words, in lower case."""
    rules = ((before, CONTEXT, CONTEXT_POINTS), (link, HOST, HOST_POINTS), (link, PATH, PATH_POINTS), (link, EXCLUDED, EXCLUDED_POINTS))
    total = F.lit(0)
    for subject, pattern, points in rules:
        total = total + F.when(subject.rlike(pattern), points).otherwise(0)
    return total


def best_link(text: str | Column) -> Column:
    """A struct of the url with most points, without tracking and trailing marks, and its score: the first of equals. An empty url if no link has any points.

    Links and the words between them are walked together, with the place reached so far, so each link knows where it began.
    """
    body = F.coalesce(col(text), F.lit(""))
    links = F.regexp_extract_all(body, F.lit(f"({LINK})"), F.lit(1))
    walked = F.arrays_zip(F.slice(F.split(body, LINK), F.lit(1), F.size(links)).alias("between"), links.alias("link"))

    def step(now: Column, x: Column) -> Column:
        start = now["at"] + F.length(x["between"])
        before = F.lower(F.substring(body, F.greatest(start - WINDOW, F.lit(0)) + 1, F.least(start, F.lit(WINDOW))))
        cleaned = without_parameters(x["link"])
        points = score(F.lower(cleaned), before)
        better = points > now["score"]
        return F.struct((start + F.length(x["link"])).alias("at"), F.when(better, points).otherwise(now["score"]).alias("score"), F.when(better, cleaned).otherwise(now["url"]).alias("url"))

    found = F.aggregate(walked, F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit("").alias("url")), step)
    return F.transform(F.array(found), lambda x: F.struct(F.regexp_replace(x["url"], TRAILING, "").alias("url"), x["score"].alias("score")))[0]
