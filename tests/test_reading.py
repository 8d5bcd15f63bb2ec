"""How messages are read at size: what a match needs is looked for first, nothing is computed twice, nothing is written that is not used."""

import contextlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stagewise.functions import expr, names, text, verdicts
from stagewise.plans import evaluation, queries

SF = "/root/testdata/sf0.001"
RULES = [*(p for r in (verdicts.BLOCKED, verdicts.STRONG, verdicts.WEAK, verdicts.HARD, verdicts.GARBAGE, text.JOB_TYPES, text.INDUSTRIES) for _, p in r), *(p for _, ps in verdicts.STATUSES for p in ps)]
PARTS = ["unfortunately", "we do not", "other candidates", "other", "candidates", "if you are", "only selected candidates", "sdn.", "bhd.", "was received", "application", "your application", "one-way video interview", "video interview", "coding test", "at Jati Bank", "webinar",
         "Unsubscribe", "--", "> said", "\n", "\r\n", "\x85", " ", "\t", ". ", ".\n", "&amp;", "&notit;", "&CounterClockwiseContourIntegral;", "&id=1", "&#x80;", "https://a.b/unsubscribe", "On Mon, 1 Jan 2001, Ann Lee wrote:", "FROM: me", "From: me", "PRIVACY policy", "İ", "risk", "bank", "intern"]


class Seen(Exception):
    pass


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("pattern,words", [(r"\bregret to inform you\b", ("regret to inform you",)), (r"ab(?:cde|efg)x*", ("cde", "efg")), (r"(?:a|b?)c", ("c",)), ("(?i)abc", ()), (r"[\x{A0}]abc", ()), (r"[a[b]]cde", ()), (r"(?i:abc)d", ("d",)), ("-{2,}", ("--",)), ("a*", ()), ("x(?!yy)z", ("xz",))])
def test_what_a_match_needs(pattern, words):
    assert expr.needed(pattern) == words


def test_rules_need_words_that_all_their_matches_hold():
    rng, found = random.Random(5), 0
    for p in RULES:
        words = expr.needed(p)
        assert words
        for _ in range(300):
            said = " ".join(rng.choice(PARTS) for _ in range(8)).lower()
            if re.search(p, said):
                found += 1
                assert any(w in said for w in words), (p, said)
    assert found > 500


def test_texts_are_read_as_by_all_patterns(spark):
    """Signatures, statuses and labels are those found when every pattern is asked of every text."""
    rng = random.Random(6)
    made = ["".join(rng.choice(PARTS) + rng.choice([" ", " ", "\n", ""]) for _ in range(rng.randrange(0, 12))) for _ in range(1500)]
    df = spark.createDataFrame([(x,) for x in made], "t string")
    each = F.array(*(F.regexp_instr("t", F.lit(f"(?dim){p}")) for p in text.SIGNATURES))
    cut = F.array_min(F.concat(F.filter(each, lambda at: at > 1), F.array(F.length("t") + 1))) - 1
    facts = F.array_join(F.filter(F.split(F.lower("t"), "".join(rf"(?<!\b{a}\.)" for a in verdicts.ABBREVIATIONS) + r"(?<=[.!?])\s+"), lambda s: ~s.rlike("|".join(verdicts.CONDITIONAL))), " ")
    said = F.regexp_replace(facts, verdicts.RECORDED, "video assessment")
    status = F.coalesce(*(F.when(said.rlike("|".join(ps)), s) for s, ps in sorted(verdicts.STATUSES, key=lambda x: -verdicts.RANK[x[0]])))
    strong = F.coalesce(*(F.when(F.col("t").rlike(p), n) for n, p in verdicts.WEAK))
    words = F.array_join(F.slice(F.filter(F.split(text.first_message("t"), text.SPACE), lambda w: w != ""), 1, text.MOST_WORDS), " ")
    got = df.select(
        (text.cut_at(F.col("t"), text.SIGNATURES, "im") == F.substring(F.col("t"), F.lit(1), cut)).alias("cut"), verdicts.factual("t").eqNullSafe(facts).alias("facts"), verdicts.detected("t").eqNullSafe(status).alias("status"),
        verdicts.hit(F.col("t"), verdicts.WEAK).eqNullSafe(strong).alias("hit"), (text.sanitized("t") == words).alias("words"), status.isNotNull().alias("some"))
    sums = got.agg(*(F.count_if(F.col(c)).alias(c) for c in got.columns)).first().asDict()
    assert sums.pop("some") > 200 and set(sums.values()) == {1500}, sums


def test_a_verdict_asks_its_rules_once(spark):
    df = spark.createDataFrame([("x@ats.example", "Hello", "we regret to inform you")], "sender string, subject string, snippet string")
    said = plan(verdicts.judged(df).select("verdict.*"))
    assert said.count("|".join(f"(?:{p})" for _, p in verdicts.STRONG)) == 1 and said.count(verdicts.RECRUITING) == 1


def test_employers_are_resolved_once(spark):
    said = plan(evaluation.employers(spark.createDataFrame([("1", "A", "a@ab.example", "s", "b")], "message_id string, employer string, sender string, subject string, snippet string")))
    assert said.count(names.NOT_NAMES) == 5  # for each witness
    assert said.count("aggregate(") == 2  # the spelling of a name, and the choice among witnesses


def test_rows_that_are_alike_are_counted_before_they_are_multiplied(spark):
    rows = spark.createDataFrame([("dev", ["a", "b"], "x", "y")] * 3 + [("dev", [], "x", "x")], "split string, tags array<string>, expected string, predicted string")
    cells = evaluation.confusion(rows)
    assert plan(cells).split("Generate")[1].count("Aggregate") == 1
    assert {tuple(r) for r in cells.collect()} == {("all", "all", "x", "y", 3), ("all", "all", "x", "x", 1), ("split", "dev", "x", "y", 3), ("split", "dev", "x", "x", 1), ("tag", "a", "x", "y", 3), ("tag", "b", "x", "y", 3)}


@pytest.mark.parametrize("name", ["repair_plan", "repaired_rows", "review_plan", "review_results", "thread_states", "thread_events", "mail_employers"])
def test_no_texts_are_written_that_are_not_used(spark, monkeypatch, name):
    def refused(df, _):
        assert not {"body", "snippet", "sender", "subject"} & {*df.columns}
        raise Seen  # nothing else is asked of the query

    monkeypatch.setattr(queries, "stash", refused)
    with contextlib.suppress(Seen):
        queries.queries()[name](spark, SF)
