"""Messages as they are read, with verdicts by hand, folded into threads."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fold

LINK = r"https?://\S+"
EXCERPT = 120
#: A thread whose number is divisible by this is judged by hand, ten days after its first message.
BY_HAND = 13


def messages(read: DataFrame) -> DataFrame:
    """Read mail (plans.evaluation.read) in the columns that a fold takes; the employer is a placeholder where only a platform is named."""
    sender = F.col("sender")
    employer = F.when(sender.contains("@board."), "Board").when(sender.contains("@ats."), "ATS").when(sender.contains(" <hr@"), F.split(sender, " <")[0]).otherwise("Unknown")
    role = F.coalesce(F.nullif(F.regexp_extract("subject", "^.* for (.+)$", 1), F.lit("")), F.regexp_extract("subject", "^(.+) at .+$", 1))
    platform = F.when(sender.contains("@ats."), "ATS").when(sender.contains("@board."), "Board").otherwise("Other")
    made = {
        "kind": F.lit("mail"),
        "arrived": F.col("arrived").cast("string"),
        "day": F.col("day").cast("string"),
        "is_valid": F.col("verdict.is_valid"),
        "reason": F.col("verdict.reason"),
        "employer": employer,
        "role": role,
        "platform": platform,
        "job_url": F.regexp_extract("body", f"({LINK})", 1),
        "excerpt": F.substring("snippet", 1, EXCERPT),
        "confidence": F.col("verdict.confidence"),
        "parsed_by": F.when(F.col("k") % 7 == 0, "llm").otherwise("rules"),
    }
    return read.select(*(made.get(n, F.col(n)).alias(n) for n in fold.fields(fold.MESSAGE)))


def verdicts_by_hand(mail: DataFrame) -> DataFrame:
    """One verdict for some threads: noise for odd ones, valid for even ones."""
    k = F.col("thread_id").cast("long")
    first = mail.where(k % BY_HAND == 0).groupBy("thread_id").agg(F.min("arrived").alias("first"))
    day = F.date_add("first", 10).cast("string")
    given = {"kind": F.lit("verdict"), "thread_id": F.col("thread_id"), "message_id": F.concat(F.lit("hand-"), "thread_id"), "arrived": day, "day": day, "is_valid": k % 2 == 0, "reason": F.lit("looked at")}
    kinds = dict(x.split() for x in fold.MESSAGE.split(", "))
    return first.select(*(given.get(n, F.lit(None).cast(kinds[n])).alias(n) for n in kinds))


def folded(read: DataFrame, as_of: date) -> DataFrame:
    return fold.folded(messages(read).unionByName(verdicts_by_hand(read)), as_of)
