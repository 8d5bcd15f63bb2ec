"""Whether a message is about an application, and which status it announces: ordered rules of our own, in the JVM.

Verdicts are a list of tiers. The first that decides gives the verdict, and the reason names the rule of it that hit. A tier's
rules are one pattern for the test; which of them it was is asked only of messages that hit.
Statuses are looked for in sentences that say what has happened: sentences about what might happen are left out first.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import RANK
from .expr import bound, col, holds, meets, needed_of

Rules = tuple[tuple[str, str], ...]

BLOCKED: Rules = (("one-time code", r"\b(?:one[- ]time|verification) code\b"), ("account notice", r"\bverify your (?:e-?mail|account)\b"), ("receipt", r"\b(?:invoice|receipt)\b"), ("newsletter", r"\bnewsletter\b|\bdigest\b"))
BLOCKED_SENDERS: Rules = (("news", r"@news\."), ("billing", r"\bbilling@"))
STRONG: Rules = (
    ("received", r"\bwe have received your application\b|\byour application for .{1,80} was received\b"),
    ("invited", r"\binvite you to an (?:interview|assessment)\b|\byour interview is scheduled\b"),
    ("declined", r"\bregret to inform you\b|\bnot be moving forward with your application\b"),
    ("offered", r"\boffer you the (?:position|role)\b|\bletter of offer\b|\boffer of employment\b"),
)
WEAK: Rules = (
    ("application", r"\byour application\b"),
    ("thanks", r"\bthank you for (?:applying|your interest)\b"),
    ("test", r"\bonline assessment\b|\bcoding test\b|\bvideo interview\b"),
    ("others", r"\bother candidates\b|\bposition has been filled\b"),
    ("meeting", r"\bmeet our hiring manager\b"),
)
#: What no confirmation says, however well the rest reads.
HARD: Rules = (("webinar", r"\bwebinar\b"), ("course", r"\benroll? now\b|\bcourse discount\b"))
GARBAGE: Rules = (("job alert", r"\b(?:new|top) (?:jobs|roles)\b|\bjob alert\b|\brecommended jobs\b"), ("career tips", r"\bcareer tips\b"))
#: Adverts of a job board, which count only if it is the sender.
BOARDS, BOARD_NOISE = r"@board\.", r"\bmatch(?:es)? your profile\b|\bapply now\b"
VENDORS, TEST_WORDS = r"@assess\.", r"\b(?:test|assessment|challenge|video interview)\b"
PLATFORMS, LOOSE = r"@(?:ats|board)\.", r"\bapplication\b|\bapplied\b|\bat [^.!?]{2,60}\s*$"
RECRUITING, PERSON = r"\brecruit\w*|\bhiring\b|\bcandidate\b|\bvacanc(?:y|ies)\b", r"^\s*[A-Z][a-z]+ [A-Z][a-z]+ <[^@<>]+@"

CONDITIONAL = (r"\bif you (?:do not|don't|are|have)\b", r"\bonly (?:shortlisted|selected) candidates\b", r"\bshould you (?:be|not)\b", r"\bin the event\b")
#: Dots after these words, in lower case, end no sentence.
ABBREVIATIONS = ("sdn", "bhd", "co", "pte", "inc", "ltd")
RECORDED = r"\b(?:on[- ]demand|one[- ]way|pre[- ]?recorded|recorded) video interviews?\b"
STATUSES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Rejected", (r"\bunfortunately\b.{0,80}\bnot\b", r"\bregret to inform\b", r"\bnot be moving forward\b", r"\bother candidates\b", r"\bposition has been filled\b", r"\bunsuccessful\b")),
    ("Offer", (r"\bpleased to offer you\b", r"\bletter of offer\b", r"\boffer of employment\b")),
    ("Interview", (r"\binvite you to an interview\b", r"\binterview is scheduled\b", r"\bmeet our hiring manager\b", r"\bvideo interview\b")),
    ("Assessment / OA", (r"\bonline assessment\b", r"\bcoding test\b", r"\bvideo assessment\b")),
    ("Applied", (r"\breceived your application\b", r"\bapplication .{1,80}\b(?:was received|has reached)\b", r"\bthank you for applying\b")),
)


def hit(text: Column, rules: Rules) -> Column:
    """The name of the first rule that the text meets; null if it meets none."""
    which = reduce(lambda out, r: out.when(text.rlike(r[1]), r[0]), rules[1:], F.when(text.rlike(rules[0][1]), rules[0][0]))
    return F.when(meets(text, *(p for _, p in rules)), which)


def judged(messages: DataFrame, snippet: str = "snippet") -> DataFrame:
    """messages (sender, subject, the snippet's column, ...) with verdict: a struct of tier, is_valid, confidence and reason. Nulls are empty."""
    given = {c: F.coalesce(F.col(c), F.lit("")) for c in ("sender", "subject", snippet)}
    df = messages.withColumns({"text__": F.lower(F.concat_ws(" ", given["subject"], given[snippet])), "head__": F.lower(F.concat_ws(" ", given["sender"], given["subject"])), "from__": F.lower(given["sender"])})
    text, head, sender = F.col("text__"), F.col("head__"), F.col("from__")
    advert = F.coalesce(hit(text, GARBAGE), F.when(meets(sender, BOARDS) & meets(text, BOARD_NOISE), "board advert"))
    found = {"blocked": hit(head, BLOCKED), "sender": hit(sender, BLOCKED_SENDERS), "strong": hit(text, STRONG), "weak": hit(text, WEAK), "hard": hit(text, HARD), "garbage": advert}

    def verdict(tier: str, valid: bool, confidence: float, rule: Column | str) -> Column:
        name = F.lit(rule) if isinstance(rule, str) else rule
        return F.struct(F.lit(tier).alias("tier"), F.lit(valid).alias("is_valid"), F.lit(confidence).alias("confidence"), F.concat(F.lit(f"{tier} ("), name, F.lit(")")).alias("reason"))

    def decided(hits: Column) -> Column:
        clean = hits["garbage"].isNull()
        near = F.when(meets(sender, PLATFORMS), "platform").when(meets(text, RECRUITING), "vocabulary").when(meets(given["sender"], PERSON), "person")
        return (
            F.when(hits["blocked"].isNotNull(), verdict("blocked", False, 0.97, hits["blocked"]))
            .when(hits["sender"].isNotNull(), verdict("blocked sender", False, 0.95, hits["sender"]))
            .when(F.coalesce(hits["strong"], hits["weak"]).isNotNull() & hits["hard"].isNotNull(), verdict("vetoed", False, 0.8, hits["hard"]))
            .when(hits["strong"].isNotNull(), verdict("strong", True, 0.95, hits["strong"]))
            .when(hits["weak"].isNotNull() & clean, verdict("weak", True, 0.85, hits["weak"]))
            .when(hits["weak"].isNotNull(), verdict("noisy", False, 0.55, hits["garbage"]))
            .when(clean & hits["hard"].isNull() & meets(sender, VENDORS) & meets(text, TEST_WORDS), verdict("vendor", True, 0.8, "test"))
            .when(clean & meets(sender, PLATFORMS) & meets(text, LOOSE), verdict("loose", True, 0.65, "platform"))
            .when(~clean, verdict("garbage", False, 0.85, hits["garbage"]))
            .otherwise(bound(near, lambda x: F.when(x.isNotNull(), verdict("near miss", False, 0.55, x)).otherwise(verdict("nothing", False, 0.85, "no rule"))))
        )

    out = bound(F.struct(*(c.alias(n) for n, c in found.items())), decided)
    return df.withColumn("verdict", out).drop("text__", "head__", "from__")


def factual(text: str | Column) -> Column:
    """The text in lower case without the sentences about what might happen. A sentence ends with a stop and a blank, but not after an abbreviation.

    A text without words of such sentences is not taken apart: only what follows its stops becomes one blank, where it is not.
    """
    end = "".join(rf"(?<!\b{a}\.)" for a in ABBREVIATIONS) + r"(?<=[.!?])"

    def said(x: Column) -> Column:
        kept = F.array_join(F.filter(F.split(x, rf"{end}\s+"), lambda s: ~s.rlike("|".join(CONDITIONAL))), " ")
        return F.when(holds(x, needed_of(CONDITIONAL)), kept).otherwise(F.when(x.rlike(r"[.!?](?:\s\s|[^\S ])"), F.regexp_replace(x, rf"{end}\s+", " ")).otherwise(x))

    return bound(F.lower(F.coalesce(col(text), F.lit(""))), said)


def in_one_sentence(words: tuple[str, ...]) -> tuple[str, ...]:
    """The longest part of each text that no end of a sentence can fall into; none if one has no such part. What needs the text needs the part."""
    parts = tuple(max(re.split(r"(?<=[.!?])\s+|^\s+", w), key=len) for w in words)
    return parts if all(parts) else ()


def detected(text: str | Column) -> Column:
    """The status of highest rank that the text tells of; null if it tells of none. Texts without any word of a status are not taken apart."""
    words = in_one_sentence(needed_of((RECORDED, *(p for _, patterns in STATUSES for p in patterns))))
    by_rank = sorted(STATUSES, key=lambda s: (RANK[s[0]], s[0]), reverse=True)

    def strongest(said: Column) -> Column:
        return F.coalesce(*(F.when(meets(said, *patterns), s) for s, patterns in by_rank))

    def found(x: Column) -> Column:
        told = bound(factual(x), lambda y: F.when(holds(y, needed_of((RECORDED,))), F.regexp_replace(y, RECORDED, "video assessment")).otherwise(y))
        return F.when(holds(x, words), bound(told, strongest))

    return bound(F.lower(F.coalesce(col(text), F.lit(""))), found)


def rank(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in RANK.items() for x in item)), status), F.lit(-1))


def stronger(body: Column, subject: Column) -> Column:
    """Of what the body and the subject tell, what ranks higher; the body's if they are level."""
    return F.when(body.isNotNull() & (rank(body) >= rank(subject)), body).otherwise(subject)


def status_of(sender: Column, subject: Column, body: Column, is_valid: Column) -> Column:
    """The status of a message; a valid one from a vendor of tests is an assessment at least."""
    found = bound(F.struct(detected(body).alias("body"), detected(subject).alias("subject")), lambda x: stronger(x["body"], x["subject"]))

    def at_least(status: Column) -> Column:
        tested = is_valid & meets(F.lower(F.coalesce(sender, F.lit(""))), VENDORS) & (rank(status) < RANK["Assessment / OA"])
        return F.when(tested, "Assessment / OA").otherwise(status)

    return bound(found, at_least)
