"""How well messages are read: one confusion count over classes, splits and tags, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, text, verdicts
from ..functions.expr import bound, pct

NONE, MISSED, ANY = "(none)", "(missed)", "(event)"
#: A reader passes if it finds events with this F1 and names this part of their statuses, in percent.
LEAST_F1, LEAST_STATUS = 95.0, 90.0


def read(mail: DataFrame) -> DataFrame:
    """Mail as it is read: snippet, verdict, detected status, and labels of what the subject says."""
    df = verdicts.judged(mail.withColumn("snippet", text.sanitized("body")))
    valid = F.col("verdict.is_valid")
    df = df.withColumn("detected_status", verdicts.status_of(F.col("sender"), F.col("subject"), F.col("snippet"), valid))
    about = F.concat_ws(" ", "role", "subject")
    return df.withColumns(
        {
            "job_type": text.labelled(about, text.JOB_TYPES, text.JOB_TYPE),
            "seniority": text.labelled("role", text.SENIORITIES, text.SENIORITY),
            "industry": text.labelled(F.concat_ws(" ", "employer", "role"), text.INDUSTRIES, text.OTHER),
            "role_family": text.labelled("role", text.ROLE_FAMILIES, text.OTHER),
            "is_ambiguous": (F.col("verdict.confidence") < 0.75) | (valid & F.col("detected_status").isNull()),
        }
    )


def judged_rows(read_mail: DataFrame, events: tuple[str, ...]) -> DataFrame:
    """(split, tags, expected, predicted): statuses; no event, and no event found, are classes of their own. A valid message without a status is taken as Applied."""
    expected = F.when(F.col("truth").isin(*events), F.col("truth")).otherwise(NONE)
    nothing = F.when(F.col("truth").isin(*events), MISSED).otherwise(NONE)
    predicted = F.when(F.col("verdict.is_valid"), F.coalesce("detected_status", F.lit("Applied"))).otherwise(nothing)
    tags = F.filter(F.split("tags", " "), lambda t: t != "")
    return read_mail.select("split", tags.alias("tags"), expected.alias("expected"), predicted.alias("predicted"))


def confusion(rows: DataFrame) -> DataFrame:
    """(dimension, value, expected, predicted, n): over all rows, by split, and by tag. A row counts once for each of its tags, and the groups come from one pass.

    Rows that are alike are counted first, so that a few are multiplied by tags and groups, and not all.
    """
    alike = rows.groupBy("split", "tags", "expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    tagged = alike.select("split", F.explode(F.concat(F.array(F.lit(None).cast("string")), "tags")).alias("tag"), "expected", "predicted", "n")
    whole = F.col("tag").isNull()
    counted = tagged.groupingSets([["expected", "predicted"], ["split", "expected", "predicted"], ["tag", "expected", "predicted"]], "split", "tag", "expected", "predicted").agg(F.sum(F.when(whole, F.col("n")).otherwise(0)).alias("rows"), F.sum(F.when(~whole, F.col("n")).otherwise(0)).alias("tagged"), F.grouping("split").alias("no_split"), F.grouping("tag").alias("no_tag"))
    by_tag = F.col("no_tag") == 0
    dimension = F.when(by_tag, "tag").when(F.col("no_split") == 0, "split").otherwise("all")
    out = counted.select(dimension.alias("dimension"), F.when(by_tag, F.col("tag")).otherwise(F.coalesce("split", F.lit("all"))).alias("value"), "expected", "predicted", F.when(by_tag, F.col("tagged")).otherwise(F.col("rows")).alias("n"))
    return out.where("value is not null and n > 0")


def scores(cells: DataFrame) -> DataFrame:
    """A row for each group and class: how many rows are of it and were taken for it, precision, recall and F1 in percent. (event) is the finding of events, whatever their status."""
    is_event, found = F.col("expected") != NONE, ~F.col("predicted").isin(NONE, MISSED)
    event = [F.when(is_event, ANY).alias("expected"), F.when(found, ANY).alias("predicted")]
    both = cells.select("dimension", "value", "expected", "predicted", "n").unionByName(cells.select("dimension", "value", *event, "n"))
    sides = F.array(F.struct(F.col("expected").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))
    hits = F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)
    sums = both.select("dimension", "value", F.explode(sides).alias("side"), hits.alias("hits")).where(~F.col("side.class").isin(NONE, MISSED))
    df = sums.groupBy("dimension", "value", F.col("side.class").alias("class")).agg(F.sum("side.support").alias("support"), F.sum("side.predicted").alias("predicted"), F.sum(F.when(F.col("side.support") > 0, F.col("hits")).otherwise(0)).alias("correct"))
    p, r, f1 = pct(F.col("correct"), F.col("predicted")), pct(F.col("correct"), F.col("support")), pct(2 * F.col("correct"), F.col("support") + F.col("predicted"))
    return df.select("*", p.alias("precision_pct"), r.alias("recall_pct"), f1.alias("f1_pct"))


def gate(cells: DataFrame) -> DataFrame:
    """One row over all rows: F1 of finding events, the part of events whose status is right, and whether both are enough."""
    is_event, found = F.col("expected") != NONE, ~F.col("predicted").isin(NONE, MISSED)

    def total(c) -> F.Column:
        return F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))

    df = cells.where("dimension = 'all'").agg(total(is_event & found).alias("tp"), total(~is_event & found).alias("fp"), total(is_event & ~found).alias("fn"), total(is_event & (F.col("expected") == F.col("predicted"))).alias("right"), total(is_event).alias("events"))
    f1, status = pct(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), pct(F.col("right"), F.col("events"))
    return df.select("tp", "fp", "fn", f1.alias("f1_pct"), status.alias("status_pct"), F.coalesce((f1 >= LEAST_F1) & (status >= LEAST_STATUS), F.lit(False)).alias("passes"))


def employers(read_mail: DataFrame) -> DataFrame:
    """(message_id, truth_name, employer, witness): whom each message names; Unknown, by no witness, if nobody."""

    def found(snippet: F.Column) -> F.Column:
        nobody = F.struct(F.lit("Unknown").alias("name"), F.lit("none").alias("witness"))
        return bound(names.witnesses("sender", "subject", snippet), lambda said: F.coalesce(names.resolved(said), nobody))

    told = read_mail.select("message_id", F.col("employer").alias("truth_name"), bound(F.col("snippet"), found).alias("found"))
    return told.select("message_id", "truth_name", F.col("found.name").alias("employer"), F.col("found.witness").alias("witness"))


def named(found: DataFrame) -> DataFrame:
    """By witness: messages, and how many of them name the right employer, to the letter and leniently, in percent."""
    exact, lenient = F.col("employer") == F.col("truth_name"), names.normal("employer") == names.normal("truth_name")
    return found.groupBy("witness").agg(F.count(F.lit(1)).alias("messages"), pct(F.count_if(exact), F.count(F.lit(1))).alias("exact_pct"), pct(F.count_if(lenient), F.count(F.lit(1))).alias("lenient_pct"))
