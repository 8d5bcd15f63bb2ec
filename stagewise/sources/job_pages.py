"""The driver's pages with structured data about a posting put in front: which, and of what shape, follows from the page's number.

The statement is in the words that Spark SQL and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

ORG = '"hiringOrganization":{"@type":"Organization","name":"Firm NUMBER &amp; Co"}'
PLACE = '"jobLocation":{"@type":"Place","address":{"addressLocality":"Ipoh","addressRegion":{"name":"Perak"},"addressCountry":"MY"}}'
PLACES = '"jobLocation":[{"address":{"addressLocality":"Penang"}},{"address":{"addressLocality":"Johor","addressCountry":{"name":"Malaysia"}}},{"address":"Nowhere"}]'
PAY = '"baseSalary":{"currency":"MYR","value":{"minValue":3000,"maxValue":4500,"unitText":"MONTH"}}'
SCRIPT = '<script type="application/ld+json">{}</script>'
#: By the rest of the page's number: one posting; nested in a graph, with a longer one; a list; malformed; tags alone; tags and a posting; nothing.
SHAPES = (
    SCRIPT.format('{"@context":"https://schema.org","@type":"JobPosting","title":"Clerk NUMBER","description":"LONG",' + f"{ORG},{PLACE},{PAY}" + ',"datePosted":"2001-02-03T10:00","employmentType":"FULL_TIME"}'),
    SCRIPT.format('{"@graph":[{"@type":"WebPage","name":"x"},{"@type":["Thing","JobPosting"],"title":{"@value":"Planner NUMBER"},"description":"LONG LONG"},{"@type":"ItemList","itemListElement":[{"item":{"@type":"JobPosting","title":"Short","description":"s"}}]}]}'),
    SCRIPT.format('[{"@type":"JobPosting","title":"Engineer NUMBER","description":["LONG",{"text":"more"}],' + PLACES + ',"employmentType":["PART_TIME","CONTRACTOR"],"hiringOrganization":"Plain NUMBER","baseSalary":{"currency":"USD","value":1200.5}}]'),
    SCRIPT.format('{"@type":"JobPosting","title":"Broken", NUMBER') + SCRIPT.format('{"mainEntity":{"offers":{"offer":{"@type":"JobPosting","title":"Deep NUMBER"}}}}'),
    "<meta content=\"Tags &amp; NUMBER\" property=\"og:title\"><META name='og:description' content='LONG'>",
    '<meta property=og:title content=Tagged><meta property="OG:Description" content="tiny">' + SCRIPT.format('{"@type":"JobPosting","title":"Untagged","description":"LONG","baseSalary":{"minValue":1,"maxValue":[2]}}'),
    "",
)


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def statement(pages: str = "pages") -> str:
    shape = " ".join(f"WHEN {i} THEN {quoted(s)}" for i, s in enumerate(SHAPES))
    said = "repeat('Work on page NUMBER. ', CAST(page_id % 4 + 1 AS INT))"
    return f"job_pages AS (SELECT page_id, replace(replace(CASE page_id % {len(SHAPES)} {shape} END, 'LONG', trim({said})), 'NUMBER', CAST(page_id AS STRING)) || coalesce(html, '') AS html FROM {pages})"


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html)."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("stagewise_pages")  # the texts hold braces, which a statement with frames in it would read
    return spark.sql(f"WITH {statement('stagewise_pages')} SELECT * FROM job_pages")
