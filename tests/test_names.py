"""Employers from several witnesses: the spelling of domains against a plain search, and the order of witnesses by hand."""

import random

import pytest
from pyspark.sql import functions as F

from stagewise.functions import names


def plain_spells(label, words):
    """All ways, one after another."""
    if not words:
        return label == ""
    w = words[0]
    return any(label.startswith(x) and plain_spells(label[len(x) :], words[1:]) for x in (w, w[0])) or (w in names.LEGAL and plain_spells(label, words[1:]))


def test_spelling_against_a_plain_search(spark):
    rng = random.Random(4)
    firms = [" ".join(rng.choice(["Jati", "Aa", "A", "Bank", "Ab", "Tasik", "Berhad", "Sdn.", "Group", "&", "Baa"]) for _ in range(rng.randrange(1, 5))) for _ in range(200)]
    labels = ["jatibank", "jb", "aaab", "jbank", "tasikb", "aab", "abaa", "baa", "jatibankberhad", "", "ta", "tasikgroup"]
    df = spark.createDataFrame([(x, f) for x in labels for f in firms], "label string, firm string")
    got = {(r["label"], r["firm"]): r["s"] for r in df.select("label", "firm", names.spells(F.col("label"), F.col("firm")).alias("s")).collect()}
    for (label, firm), s in got.items():
        words = [w for w in firm.lower().replace("&", "").split() if w]
        assert s == (len(label) >= 3 and plain_spells(label, words)), (label, firm)
    assert 20 < sum(got.values()) < len(got) / 2


CASES = [
    ("hr@jatibank.example", "Hello", "Jati Bank Berhad thanks you", "Jati Bank Berhad", "domain and text"),
    ("Rimba Retail <hr@x1.example>", "Your application to Mega Bank", "", "Mega Bank", "subject"),
    ("Rimba Retail <hr@x1.example>", "Hello", "We are hiring at Jati Bank", "Rimba Retail", "display name"),
    ("Jane Tan <jane@ats.example>", "Hello", "We are hiring at Jati Bank", "Jati Bank", "body"),
    ("Jane Tan <jane@bayu.example>", "Hello", "", "Bayu", "domain"),
    ("x@ats.example", "Interview with Mega Bank", "your place at Mega Bank Holdings Group", "Mega Bank Holdings Group", "body"),
    ("x@ats.example", "Update", None, None, None),
    (None, None, None, None, None),
]


def test_witnesses_in_their_order(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, sender string, subject string, body string")
    got = {r["i"]: r["r"] for r in df.select("i", names.resolved(names.witnesses("sender", "subject", "body")).alias("r")).collect()}
    assert [(got[i] and got[i]["name"], got[i] and got[i]["witness"]) for i in range(len(CASES))] == [c[3:] for c in CASES]


@pytest.mark.parametrize("a,b,same", [("Jati Bank Bhd.", "jati bank", True), ("Jati", "Jati Bank", False), (None, "", True)])
def test_lenient_comparison(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select((names.normal("a") == names.normal("b")).alias("s")).first()["s"] == same
