"""Messages whose bodies could not be read are read again: a stream of dead letters that feeds back, and the order in which things were first seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.prefix import running

MESSAGE = "message_id string, arrived timestamp"
LETTER = f"{MESSAGE}, attempts int"


def read_with_retries(spark: SparkSession, new: str, dead: str, out: str, fetch: Callable[[DataFrame], DataFrame], checkpoint: str, most: int = 3) -> StreamingQuery:
    """Read what has come since the last run, and the dead letters of runs before it, as one stream that ends.

    new holds MESSAGE, dead and out are this function's. fetch adds body, null where a body could not be read. Read bodies go to out; others become
    dead letters with one attempt more, until `most` are made, and then go to out without a body. What a micro-batch writes goes under its number, and
    replaces what an attempt of it that failed half-way has left, so nothing is lost or written twice.
    """
    spark.createDataFrame([], LETTER).write.mode("append").parquet(f"{dead}/batch=-1")  # so that there is a folder to read
    fresh = spark.readStream.schema(MESSAGE).parquet(new).withColumn("attempts", F.lit(0))
    again = spark.readStream.schema(LETTER).option("recursiveFileLookup", True).parquet(dead)

    def write(batch: DataFrame, number: int) -> None:
        tried = fetch(batch).withColumn("attempts", F.col("attempts") + 1).persist()
        over = F.col("body").isNotNull() | (F.col("attempts") >= most)
        tried.where(over).select("message_id", "arrived", "attempts", "body").write.mode("overwrite").parquet(f"{out}/batch={number}")
        tried.where(~over).select("message_id", "arrived", "attempts").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        tried.unpersist()

    return fresh.unionByName(again).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(delivered: DataFrame) -> DataFrame:
    """Each message (message_id, arrived, attempts, body) once: with a body if any delivery has one, then the first to arrive."""
    rest = [c for c in delivered.columns if c not in ("message_id", "arrived", "attempts")]
    best = delivered.groupBy("message_id").agg(F.min(F.struct(F.col("body").isNull().alias("empty"), "arrived", "attempts", *rest)).alias("m"))
    return best.select("message_id", "m.arrived", "m.attempts", *(f"m.{c}" for c in rest))


def first_seen(listings: DataFrame) -> DataFrame:
    """(id, listing, position, n) for listings (listing, position, id): each id once, where it was first seen, listings in their order, and its number in that order. Nulls are no ids."""
    first = listings.where("id is not null").groupBy("id").agg(F.min(F.struct("listing", "position")).alias("at")).select("id", "at.listing", "at.position")
    return running(first, [F.col("listing"), F.col("position"), F.col("id")], {"n": F.lit(1).cast("long")})
