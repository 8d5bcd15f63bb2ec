"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for all operators."""

import public_tokenizers
import pytest

from stagewise.llm import bpe, chat, fingerprint, mixing, neardup, quality, tokenfile, toxicity, warc

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet " * 20_000

ON_DOCS = {
    "near_dedup": neardup.classes,
    "bpe": lambda d: bpe.round_trip(d, RANKS, PATTERN),
    "token_file": lambda d: tokenfile.round_trip(d, WORDS),
    "toxicity": lambda d: toxicity.score(d, toxicity.Model({"awful": 2.0}, frozenset(), [-1.0, 2.0, 0.5])),
    "mix": mixing.mix,
    "simhash": fingerprint.search,
    "quality": quality.assess,
}
SCHEMA = "doc_id long, text string, source string, bucket string, size long, h string, id long, range string, at string, near string"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None, None), (2, "", "b"), (2, "", "b"), (3, LONG, "a"), (None, "a text", "a"), (None, None, "b"), (4, " \t\n", None), (5, "a text", "a")]
    return spark.createDataFrame([(*r, *["x", 7, "x", 9, "x", "x", "x"]) for r in rows], SCHEMA)


@pytest.mark.parametrize("name", ON_DOCS)
def test_awkward_rows_each_give_a_row(spark, awkward, name):
    got = sorted(ON_DOCS[name](awkward).select("doc_id").collect(), key=repr)
    assert got == sorted(awkward.select("doc_id").collect(), key=repr)


@pytest.mark.parametrize("name", ON_DOCS)
def test_an_empty_table_gives_an_empty_one(spark, awkward, name):
    assert ON_DOCS[name](awkward.limit(0)).count() == 0


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, spans int"
    assert chat.with_hostile(spark.createDataFrame([], schema)).count() == 1
    rows = [(1, None, None, None, "x", 1), (1, 2, "user", LONG, "x", 1), (1, 2, "user", LONG, "x", 1), (None, 1, "assistant", "", "x", 1)]
    got = {r["conv_id"]: r for r in chat.with_hostile(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, -7: 2}
    assert got[-7]["loss_chars"] == len("</s>[INST] ok [/INST]") and got[None]["loss_chars"] == 0


def test_pages(spark):
    schema = "page_id long, url string, html string, name string, frame int, sha string"
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", "same"), (2, None, "same"), (None, "u", "same"), (3, "u\r\nx: y", None), (4, "u", ""), (5, "u", LONG), (6, "u", "own"), (6, "u", "own")]
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(spark.createDataFrame([(*r, "x", 1, "x") for r in rows], schema)).collect())
    assert got == [(0, "revisit", 2, 4), (1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, len(LONG)), (6, "response", None, 3), (6, "response", None, 3)]
