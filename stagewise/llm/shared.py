"""Small helpers that several operators use."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Characters that are not one of the six ASCII blanks make up a word.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a table that one file holds at least, where a table of known size is written.
ROWS_A_FILE = 50_000

Batches = Iterator[pa.RecordBatch]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver's Python ends, since results are read from it until then."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark.sparkContext._jvm, path)
    return path


def removed(jvm, path: str) -> None:
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:  # the JVM has ended before us
        pass


def stash(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage at a table that survives lost executors.

    rows: about how many rows it is made of, if known; few are written by few tasks, since each task writes a file, for which
    Hadoop without its native library starts processes beside the executor.
    """
    path = scratch(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(min(tasks(df.sparkSession), 1 + rows // ROWS_A_FILE))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The function for mapInArrow; memory that Arrow keeps for later goes back to the system after each batch, as workers live on
    beside each other and the executor's JVM."""

    def run(batches: Batches) -> Batches:
        for b in work(batches):
            yield b
            del b
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return run


def freed(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has been written: Spark removes them when the driver's memory is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def tasks(spark: SparkSession) -> int:
    """Number of partitions that the cluster's owner wants for a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """About so many rows, and never more than twice as many, from all over the table: each with the same probability."""
    total = df.count()
    return df if total <= rows else df.sample(fraction=rows / total, seed=7).limit(2 * rows)


class Ranges(NamedTuple):
    """Disjoint ranges of a column of whole numbers, descending, of about equal numbers of rows: the greatest value of each."""

    heads: Broadcast[np.ndarray]
    n: int

    def numbers(self, values: pa.Array) -> np.ndarray:
        """The numbers of the ranges of an array's values, in a task; nulls are in the last."""
        ascending, last = self.heads.value[::-1], self.n - 1
        at = len(ascending) - 1 - np.searchsorted(ascending, values.fill_null(0).to_numpy(zero_copy_only=False))
        return np.where(values.is_null().to_numpy(zero_copy_only=False), last, np.clip(at, 0, last)).astype(np.int32)

    def number(self, column: Column) -> Column:
        """The number of a value's range; nulls are in the last."""
        return F.arrow_udf(lambda values: pa.array(self.numbers(values)), "int")(column.cast("long"))

    def also(self, column: Column) -> Column:
        """For the greatest value of a range, the number of the range before, or of the last one for the first; else null."""
        heads, n = self.heads, self.n

        def served(values: pa.Array) -> pa.Array:
            if not len(heads.value):
                return pa.array(np.zeros(len(values), np.int32))
            ascending, v = heads.value[::-1], values.fill_null(0).to_numpy(zero_copy_only=False)
            i = np.minimum(np.searchsorted(ascending, v), len(ascending) - 1)
            leads = (ascending[i] == v) & values.is_valid().to_numpy(zero_copy_only=False)
            return pa.array((len(ascending) - 2 - i) % n, pa.int32(), mask=~leads)

        return F.arrow_udf(served, "int")(column.cast("long"))


def ranges(df: DataFrame, column: str) -> Ranges:
    """As many ranges as the cluster's owner wants tasks. Spark samples their bounds; the driver holds one number of each."""
    values = df.select(F.col(column).cast("long").alias("v")).where("v is not null")
    dealt = values.repartitionByRange(max(1, tasks(df.sparkSession)), F.col("v").desc())
    heads = sorted({r["head"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.max("v").alias("head")).collect()}, reverse=True)
    return Ranges(df.sparkSession.sparkContext.broadcast(np.array(heads, np.int64)), max(1, len(heads)))
