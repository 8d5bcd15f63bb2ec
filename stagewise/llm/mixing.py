"""Mix sources to target weights along a time-varying curriculum. DataFrame functions only.

Each source's weight moves over the run along a schedule: straight lines between (time, weight) points, times in [0, 1].
Without one it moves linearly: at time u the source is drawn with density target * (1 + tilt * (2u - 1)). A schedule is
normalised so that its integral over the run is the source's target. The demand up to u, a quadratic function between two
points, is inverted in closed form at the words that stand before a document, which gives the document's training
position; documents are range-sorted by it.

Running sums never gather a source in one task: documents fall into buckets by a hash of their id,
sums are taken per (source, bucket) with partial aggregation, and only the sums are accumulated per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, stash, text_of

#: Documents of a source fall into so many buckets, by the first three hex digits of their id's MD5.
BUCKET_DIGITS = 3


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, tilt: float = 0.8) -> DataFrame:
    """Add idx, target and tilt to (source, source_size), one row per source.

    Sources in code point order, null last, get the weights in turn. A target stops at max_repeats times
    its source's size; the excess goes to the others by weight. All words together stay the same, so for
    max_repeats >= 1 targets always exist. Sources are filled in order of the level at which they stop:
    those below the level that balances the sum are capped, the others share the rest by weight.
    """
    everyone = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(int(w)) for w in weights])
    df = sources.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    df = df.withColumn("weight", F.element_at(given, (F.col("idx") % len(weights) + 1).cast("int")).cast("long"))
    df = df.withColumn("cap", F.col("source_size") * max_repeats)
    filled = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "idx")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = "decimal(19,0)"
    df = df.withColumns(
        {
            "total": F.sum("source_size").over(everyone),
            "n_sources": F.count(F.lit(1)).over(everyone),
            "taken_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_rest": F.sum("weight").over(after),
        }
    )
    df = df.withColumn("capped", (F.col("total") - F.col("taken_before")).cast(big) * F.col("weight").cast(big) > F.col("cap").cast(big) * F.col("weight_rest").cast(big))
    df = df.withColumns(
        {
            "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everyone), F.lit(0)),
            "weight_open": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everyone),
        }
    )
    share = (F.col("weight") * F.col("rest")).cast("double") / F.col("weight_open").cast("double")
    slope = F.when(F.col("n_sources") > 1, F.lit(float(tilt)) * (F.lit(2.0) * F.col("idx") / (F.col("n_sources") - 1) - F.lit(1.0))).otherwise(F.lit(0.0))
    return df.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"), slope.alias("tilt"))


def position(demand: Column, tilt: Column) -> Column:
    """The time at which a source's cumulative demand reaches this fraction of its target."""
    left = F.lit(1.0) - tilt
    return F.lit(2.0) * demand / (left + F.sqrt(left * left + F.lit(4.0) * tilt * demand))


Schedule = Sequence[tuple[float, float]]
LINE = "array<struct<demand: double, start: double, length: double, w0: double, w1: double>>"


def lines(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """The straight lines of a schedule whose integral is made 1: demand before, start, length, weights at both ends."""
    points = sorted(schedule)
    if len(points) < 2 or points[0][0] != 0 or points[-1][0] != 1 or min(w for _, w in points) < 0:
        raise ValueError("a schedule begins at 0, ends at 1, and has no negative weights")
    spans = [(u, v - u, a, b) for (u, a), (v, b) in zip(points, points[1:], strict=False) if v > u]
    area = sum(n * (a + b) / 2 for _, n, a, b in spans)
    if not area:
        raise ValueError("a schedule needs a weight above 0")
    out, demand = [], 0.0
    for u, n, a, b in spans:
        if a or b:
            out.append((demand, u, n, a / area, b / area))
            demand += n * (a + b) / 2 / area
    return out


def curve(schedules: dict[str | None, Schedule] | None) -> Column:
    """The lines of a row's source; null if it has no schedule."""
    out = F.lit(None).cast(LINE)
    for source, schedule in (schedules or {}).items():
        rows = F.array(*[F.struct(*map(F.lit, map(float, x))) for x in lines(schedule)]).cast(LINE)
        out = F.when(F.col("source").eqNullSafe(F.lit(source)), rows).otherwise(out)
    return out


def along(demand: Column, curve: Column) -> Column:
    """The time at which the demand along the lines reaches this fraction."""
    last = F.element_at(F.filter(curve, lambda x: x["demand"] <= F.coalesce(demand, F.lit(0.0))), -1)

    def within(x: Column) -> Column:
        left = F.greatest(demand - x["demand"], F.lit(0.0))
        root = F.sqrt(F.greatest(x["w0"] * x["w0"] + 2 * (x["w1"] - x["w0"]) * left / x["length"], F.lit(0.0)))
        return x["start"] + F.least(F.coalesce(F.try_divide(2 * left, x["w0"] + root), F.lit(0.0)), x["length"])

    return F.get(F.transform(F.array(last), within), 0)


def planned(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, tilt: float = 0.8, schedules: dict[str | None, Schedule] | None = None) -> DataFrame:
    """mix() without position and order, with what positions are made of: before, the words of a pass before the row, tilt and curve."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = stash(docs.select("doc_id", "source", words(text_of("text")).alias("size")), "mix-sizes")
    keyed = sized.select("*", digest.alias("ord"), F.substring(digest, 1, BUCKET_DIGITS).alias("bucket"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goals = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats, tilt)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    starts = starts.join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    within = Window.partitionBy("source", "bucket").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = keyed.withColumn("in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0)))
    df = df.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    df = df.withColumn("before", F.col("bucket_start") + F.col("in_bucket"))
    goal = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    df = df.withColumn("passes", passes)
    rest = goal - F.col("passes") * F.col("source_size")
    df = df.withColumn("taken", F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))))
    return df.select("doc_id", "source", "size", "source_size", "target", "tilt", curve(schedules).alias("curve"), "before", "taken")


def due(before: Column, target: Column, tilt: Column, curve: Column) -> Column:
    """The position at which a copy is due, with so many words of its source before it in all passes."""
    demand = before.cast("double") / target
    return F.when(curve.isNull(), position(demand, tilt)).otherwise(along(demand, curve))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, tilt: float = 0.8, schedules: dict[str | None, Schedule] | None = None) -> DataFrame:
    """One row per row of (doc_id, text, source): doc_id, source, size, source_size, target, taken, position.

    taken: words that the mix takes of the document: whole passes over its source, then part of a pass,
    cut inside the document where the target is reached. Their sum over a source is its target, rounded down.
    position: when its first copy is due, null if nothing is taken; rows come range-sorted by it.
    Null or empty texts have size 0 and are never taken; a null source is a source of its own; equal ids
    are ordered by size, and rows that agree in both are interchangeable. No rows give no rows.
    schedules: (time, weight) points by source, for those that do not move linearly.
    Only the three columns named are read, so further columns cannot clash.
    """
    df = planned(docs, weights, max_repeats, tilt, schedules)
    first = F.when(F.col("taken") > 0, due(F.col("before"), F.col("target"), F.col("tilt"), F.col("curve")))
    return df.select("doc_id", "source", "size", "source_size", "target", "taken", first.alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def resample(docs: DataFrame, position: str | None = None, **options) -> DataFrame:
    """The mix as documents: each row as often as its taken words fill it, to the nearest whole copy, in training order.

    Every copy has its own position: that of pass k over the source stands k * source_size words later in the source's
    demand than the first. Rows come range-sorted by it, and `position` names a column to hold it, if given.
    Rows with no words are kept once: they weigh nothing, have no position and come last. A document of which less than
    half a copy is taken goes. Rows must have distinct ids; ids that repeat share their first row's decision. Columns of any
    name are left as they are; no rows give no rows.
    """
    first = F.min(F.struct("before", "source_size", "target", "tilt", "curve")).alias("mix_first")
    plan = planned(docs, **options).groupBy("doc_id").agg(F.sum("taken").alias("mix_taken"), F.sum("size").alias("mix_size"), first)
    copies = F.when(F.col("mix_size") == 0, F.lit(1)).otherwise(F.round(F.col("mix_taken") / F.col("mix_size")).cast("int"))
    plan = plan.select(F.col("doc_id").alias("mix_doc_id"), copies.alias("mix_copies"), "mix_size", "mix_first").where("mix_copies > 0")
    held = docs.select(F.struct(*docs.columns).alias("row"))
    kept = held.join(plan, F.col("row.doc_id").eqNullSafe(F.col("mix_doc_id")))
    kept = kept.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    f = F.col("mix_first")
    before = F.least(F.col("mix_pass") * f["source_size"] + f["before"], f["target"])
    kept = kept.withColumn("mix_due", F.when(F.col("mix_size") > 0, due(before, f["target"], f["tilt"], f["curve"])))
    named = [F.col("mix_due").alias(position)] if position else []
    return kept.orderBy(F.col("mix_due").asc_nulls_last(), "row.doc_id").select(*(F.col("row")[c].alias(c) for c in docs.columns), *named)
