"""A second, paid reading of doubtful messages within a month's budget: what is known already, what may be asked, and what must wait."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running

#: A reading with less confidence changes nothing.
LEAST = 0.6


def planned(messages: DataFrame, known: DataFrame, spent: DataFrame, budget: int, cap: int) -> DataFrame:
    """messages (message_id, month, arrived, cost, ...) with plan: cached, ask, over cap or over budget.

    known (message_id) has been read before and costs nothing. Of the others, by arrival and id, each is asked as long as something of its month's
    budget is left before it, spent (month, cost) included: the last one may go beyond. No more than `cap` are asked in all, the first ones.
    Costs are whole numbers, so that sums are exact. Running sums are those of ranges of the order: no task sees all messages.
    """
    df = messages.join(known.select("message_id", F.lit(True).alias("cached__")), "message_id", "left")
    cached = df.where("cached__").drop("cached__").withColumn("plan", F.lit("cached"))
    order = [F.col("month"), F.col("arrived"), F.col("message_id")]
    new = running(df.where("cached__ is null").drop("cached__"), order, {"sum__": F.col("cost")})
    starts = new.groupBy(F.col("month").alias("month__")).agg(F.min(F.col("sum__") - F.coalesce("cost", F.lit(0))).alias("start__"))  # a row a month
    before = spent.groupBy(F.col("month").alias("month__")).agg(F.sum("cost").alias("spent__"))
    months = starts.join(before, "month__", "left")
    in_month = F.col("sum__") - F.coalesce("cost", F.lit(0)) - F.col("start__") + F.coalesce("spent__", F.lit(0))
    afforded = new.join(F.broadcast(months), F.col("month") == F.col("month__")).withColumn("afforded__", in_month < budget)
    counted = running(afforded, [F.col("arrived"), F.col("message_id")], {"n__": F.col("afforded__").cast("long")})
    plan = F.when(~F.col("afforded__"), "over budget").when(F.col("n__") > cap, "over cap").otherwise("ask")
    return cached.unionByName(counted.select(*messages.columns, plan.alias("plan")))


def corrected(messages: DataFrame, readings: DataFrame) -> DataFrame:
    """messages (message_id, is_valid, detected_status, confidence, parsed_by) after readings (message_id, is_event, status, sureness) that are sure enough; one reading a message."""
    df = messages.join(readings.select(F.col("message_id"), "is_event", "status", "sureness"), "message_id", "left")
    sure = F.coalesce(F.col("sureness") >= LEAST, F.lit(False))
    told = sure & F.col("is_event") & (F.coalesce("status", F.lit("")) != "")
    made = {
        "is_valid": F.when(sure, F.col("is_event")).otherwise(F.col("is_valid")),
        "detected_status": F.when(told, F.col("status")).otherwise(F.col("detected_status")),
        "confidence": F.when(sure, F.col("sureness")).otherwise(F.col("confidence")),
        "parsed_by": F.when(sure, "llm").otherwise(F.col("parsed_by")),
    }
    return df.select(*(made.get(c, F.col(c)).alias(c) for c in messages.columns))
