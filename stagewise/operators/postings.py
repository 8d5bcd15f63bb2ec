"""What pages tell machines about a posting: JSON-LD, searched whatever its nesting, and OpenGraph tags.

JSON becomes Spark's VARIANT. It is walked level by level: each round unfolds the objects and lists of the round before,
so there are as many rounds as the deepest page has levels, and all pages go together. Malformed JSON tells nothing.
Of several postings of a page the one with the longest description counts; of those, the first by title and date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import stash

BLOCK = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
TAG = r"(?is)(<meta\b[^>]*>)"
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: Where an object keeps its text, in the order in which it is looked for.
TEXT_KEYS = ("@value", "name", "text", "value")
LONGEST, TITLE, PLACES, KIND = 4000, 150, 200, 120


def at(v: str, key: str, kind: str = "string") -> str:
    return f"try_variant_get({v}, \"$['{key}']\", '{kind}')"


def plain(v: str) -> str:
    """SQL for the text of a scalar, or of the first key of an object that has one."""
    of_object = ", ".join(f"nullif({at(v, k)}, '')" for k in TEXT_KEYS)
    return f"CASE WHEN schema_of_variant({v}) LIKE 'OBJECT%' THEN coalesce({of_object}, '') WHEN schema_of_variant({v}) LIKE 'ARRAY%' OR {v} IS NULL THEN '' ELSE coalesce(try_variant_get({v}, '$', 'string'), '') END"


def said(v: str) -> str:
    """SQL for the text of any value: those of a list side by side; nothing for none."""
    return f"CASE WHEN schema_of_variant({v}) LIKE 'ARRAY%' THEN array_join(transform(try_variant_get({v}, '$', 'array<variant>'), e -> {plain('e')}), ' ') ELSE {plain(v)} END"


def number(v: str) -> str:
    """SQL for a number that may stand in an object under value, or first in a list."""
    inner = f"CASE WHEN schema_of_variant({v}) LIKE 'OBJECT%' THEN {at(v, 'value', 'variant')} WHEN schema_of_variant({v}) LIKE 'ARRAY%' THEN try_variant_get({v}, '$[0]', 'variant') ELSE {v} END"
    return f"try_variant_get({inner}, '$', 'string')"


def cleaned(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text.unescaped(x), text.SPACE, " "), "^ | $", "")


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or not; empty if it has none."""
    return F.concat(*(F.regexp_extract(tag, rf"(?i)(?<![\w:-])(?:{name}){VALUE}", g) for g in (1, 2, 3)))


def meta(html: Column, wanted: str) -> Column:
    """The content of the first tag of that property or name, its attributes in any order."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(TAG), F.lit(1)), lambda t: F.lower(F.coalesce(F.nullif(attribute(t, "property"), F.lit("")), attribute(t, "name"))) == wanted)
    return F.when(F.size(tags) > 0, cleaned(attribute(F.get(tags, F.lit(0)), "content"))).otherwise("")


def walked(blocks: DataFrame) -> DataFrame:
    """(key, v) of every posting in blocks (key, v), at any depth."""
    spark, found = blocks.sparkSession, []
    level = stash(blocks, "level")
    while not level.isEmpty():
        kinds = f"coalesce({at('v', '@type', 'array<string>')}, array({at('v', '@type')}))"
        found.append(level.where(f"schema_of_variant(v) LIKE 'OBJECT%' AND coalesce(array_contains({kinds}, 'JobPosting'), false)"))
        inner = spark.sql("SELECT l.key, e.value AS v FROM {level} AS l, LATERAL variant_explode(l.v) AS e WHERE schema_of_variant(e.value) LIKE 'OBJECT%' OR schema_of_variant(e.value) LIKE 'ARRAY%'", level=level)
        level = stash(inner, "level")
    return reduce(DataFrame.unionByName, found, level)


def salary(v: str) -> Column:
    """A range or one number, with its currency and unit; empty if neither is given."""
    base, value = at(v, "baseSalary", "variant"), f"try_variant_get({v}, '$.baseSalary.value', 'variant')"
    low, high = (f"coalesce({number(at(base, k, 'variant'))}, {number(at(value, k, 'variant'))})" for k in ("minValue", "maxValue"))
    unit = F.lower(F.coalesce(F.expr(at(value, "unitText")), F.lit("")))
    one = F.expr(f"CASE WHEN schema_of_variant({value}) LIKE 'OBJECT%' THEN {number(value)} ELSE try_variant_get({value}, '$', 'string') END")
    currency = F.coalesce(F.expr(said(at(base, "currency", "variant"))), F.lit(""))
    suffix = F.concat(F.when(currency != "", F.concat(F.lit(" "), currency)).otherwise(""), F.when(unit != "", F.concat(F.lit(" / "), unit)).otherwise(""))
    spread = F.when(F.expr(low).isNotNull() & F.expr(high).isNotNull(), F.concat(F.expr(low), F.lit("\u2013"), F.expr(high), suffix))
    return F.when(F.expr(f"schema_of_variant({base}) LIKE 'OBJECT%'"), F.coalesce(spread, F.when(one.rlike(r"^-?[0-9.]+$"), F.concat(one, suffix)), F.lit(""))).otherwise("")


def described(postings: DataFrame) -> DataFrame:
    """The fields of each posting (key, v)."""
    places = f"coalesce({at('v', 'jobLocation', 'array<variant>')}, array({at('v', 'jobLocation', 'variant')}))"
    parts = ", ".join(f"nullif({said(at(at('p', 'address', 'variant'), k, 'variant'))}, '')" for k in ("addressLocality", "addressRegion", "addressCountry"))
    place = F.expr(f"array_join(filter(transform({places}, p -> array_join(filter(array({parts}), x -> x IS NOT NULL), ', ')), x -> x <> ''), '; ')")
    kind = F.expr(f"coalesce(array_join({at('v', 'employmentType', 'array<string>')}, ' / '), {at('v', 'employmentType')}, '')")

    def field(name: str) -> Column:
        return cleaned(F.coalesce(F.expr(said(at("v", name, "variant"))), F.lit("")))

    return postings.select(
        "key",
        field("title").alias("title"),
        field("hiringOrganization").alias("company"),
        F.substring(field("description"), 1, LONGEST).alias("description"),
        F.substring(cleaned(place), 1, PLACES).alias("location"),
        salary("v").alias("salary"),
        F.substring(field("datePosted"), 1, 10).alias("posted_date"),
        F.substring(F.initcap(F.replace(cleaned(kind), F.lit("_"), F.lit(" "))), 1, KIND).alias("employment_type"),
        F.length(F.coalesce(F.expr(said(at("v", "description", "variant"))), F.lit(""))).alias("length"),
    )


FIELDS = ("company", "location", "salary", "posted_date", "employment_type")


def extracted(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ok, title, description, and FIELDS) for each page: tags' titles before postings', the longer description.

    ok is false where there is neither. A null page tells nothing; pages of one key are to be one row.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    slim = pages.select(F.col(key).alias("key"), page.alias("html"))
    blocks = slim.select("key", F.explode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))).alias("json")).select("key", F.try_parse_json(F.trim("json")).alias("v")).where("v IS NOT NULL")
    one = described(walked(blocks))
    fields = [c for c in one.columns if c not in ("key", "length")]
    order = ("order", "title", "posted_date")
    ranked = one.withColumn("order", -F.col("length"))
    best = ranked.groupBy("key").agg(F.min(F.struct(*order, *(c for c in fields if c not in order))).alias("ld"))
    tagged = slim.select("key", meta(F.col("html"), "og:title").alias("og_title"), meta(F.col("html"), "og:description").alias("og_description"), F.substring(cleaned(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, TITLE).alias("page_title"))
    df = tagged.join(best, "key", "left")

    def ld(name: str) -> Column:
        return F.coalesce(F.col(f"ld.{name}"), F.lit(""))

    bare = F.when(F.col("og_title") == "", F.col("page_title")).otherwise("")
    title = F.coalesce(*(F.nullif(x, F.lit("")) for x in (F.col("og_title"), ld("title"), bare)), F.lit(""))
    description = F.when(F.length(ld("description")) >= F.length("og_description"), ld("description")).otherwise(F.col("og_description"))
    out = df.select(F.col("key").alias(key), title.alias("title"), description.alias("description"), *(ld(n).alias(n) for n in FIELDS))
    return out.select(key, ((F.col("title") != "") | (F.col("description") != "")).alias("ok"), "title", "description", *FIELDS)
