"""Structured data of pages and the choice of links, by hand and against plain Python."""

import random
import re

import pytest

from stagewise.functions import links
from stagewise.operators import postings
from stagewise.sources import job_pages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    return {r["page_id"]: r for r in postings.extracted(job_pages.job_pages(spark, SF)).collect()}


def said(n):
    return " ".join([f"Work on page {n}."] * (n % 4 + 1))


def test_one_posting_with_all_its_fields(found):
    r = found[7]
    assert (r["ok"], r["title"], r["company"], r["description"], r["posted_date"]) == (True, "Clerk 7", "Firm 7 & Co", said(7), "2001-02-03")
    assert (r["location"], r["salary"], r["employment_type"]) == ("Ipoh, Perak, MY", "3000–4500 MYR / month", "Full Time")


def test_the_longest_of_a_graph(found):
    assert (found[8]["title"], found[8]["description"]) == ("Planner 8", f"{said(8)} {said(8)}")


def test_lists_of_texts_places_and_kinds(found):
    r = found[9]
    assert (r["title"], r["company"], r["description"]) == ("Engineer 9", "Plain 9", f"{said(9)} more")
    assert (r["location"], r["salary"], r["employment_type"]) == ("Penang; Johor, Malaysia", "1200.5 USD", "Part Time / Contractor")


def test_malformed_json_tells_nothing_and_deep_nodes_are_found(found):
    assert (found[10]["title"], found[10]["description"]) == ("Deep 10", "")


def test_tags_in_any_order_of_attributes(found):
    assert (found[11]["title"], found[11]["description"]) == ("Tags & 11", said(11))
    assert (found[12]["title"], found[12]["description"], found[12]["salary"]) == ("Tagged", said(12), "1–2")


def test_titles_of_pages_are_the_last_resort(found, spark):
    assert found[13]["ok"] and found[13]["title"] and not found[13]["company"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, '<script type="application/ld+json">7</script>'), (4, "<meta name='og:title'>")], "page_id long, html string")
    assert [(r["ok"], r["title"]) for r in postings.extracted(odd).orderBy("page_id").collect()] == [(False, "")] * 4
    assert postings.extracted(odd.limit(0)).count() == 0


def plain_link(text):
    best, url = 0, ""
    for m in re.finditer(links.LINK, text or ""):
        base, mark, query = m[0].partition("?")
        kept = [p for p in query.split("&") if p and not re.match(r"(?i)(?:utm_[\w-]+|gclid|ref)=", p)]
        cleaned = base + ("?" + "&".join(kept) if kept else "")
        before = text[max(0, m.start() - links.WINDOW) : m.start()].lower()
        points = sum(p for x, pattern, p in ((before, links.CONTEXT, 4), (cleaned.lower(), links.HOST, 3), (cleaned.lower(), links.PATH, 2), (cleaned.lower(), links.EXCLUDED, -10)) if re.search(pattern, x))
        if points > best:
            best, url = points, cleaned
    return re.sub(links.TRAILING, "", url), best


def test_the_best_link_against_plain_python(spark):
    rng = random.Random(5)
    parts = ["Apply here: ", "view the job ", "hello ", "x" * 130 + " ", "\n", "https://ats.example/j/1?utm_source=m&id=2 ", "https://a.example/careers/9. ", "http://social.example/job ", "https://b.example/logo.png ", "https://c.example/ ", "http://d.example/apply?ref=1,", "É "]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["", None]
    got = spark.createDataFrame([(t,) for t in made], "t string").select(links.best_link("t").alias("l")).collect()
    assert [(r["l"]["url"], r["l"]["score"]) for r in got] == [plain_link(t) for t in made]
