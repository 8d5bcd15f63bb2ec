"""The corpus pipeline: documents in, token ids out.

Every stage works on all that the one before kept, and is written as Parquet and read again before the next.
"""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.llm import bpe, linedup, mixing, neardup, toxicity
from stagewise.llm.shared import stash, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts to be toxic go."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus, or nearly so, go; all documents stay."""
    return linedup.deduplicated(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return neardup.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, every copy with its mix_position, sorted by it."""
    return mixing.resample(docs, position="mix_position")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the bytes they decode to, and mix_position, of every copy that is left."""
    named = docs.select(F.struct("doc_id", "mix_position").alias("doc_id"), "text")
    out = bpe.round_trip(named, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "doc_id.mix_position")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("mix", mixed),
    ("byte_bpe", encoded),
]
#: SQL cannot express the first stage. tests/llm/test_pipeline.py runs all five against a brute-force version of each.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Null texts are empty and weigh nothing in the mix; rows without an id stay through
    the stages that compare documents; no documents give no rows. Further columns are carried up to the last stage.
    """
    df = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        df = stash(stage(spark, df, sf_dir), name)
    return STAGES[-1][1](spark, df, sf_dir)
