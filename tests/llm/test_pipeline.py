"""The pipeline against a brute-force version of all its stages, each on the output of the one before."""

import hashlib
import random
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_against_brute_force import alike_pairs, component_of
from test_linedup import brute

from stagewise.llm import bpe, sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CURSES = ("grobnik", "flimzard")
MISSPELT = ("gorbnik", "flimzrd", "xgrobnik")


def made(rng):
    """(doc_id, text, source, toxic): lines of invented words; copies, near copies, repeated and edited lines, curses."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(900)]

    def line(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = [line(9) for _ in range(6)]
    docs = []
    for i in range(170):
        lines = [line(rng.randrange(4, 14)) for _ in range(rng.randrange(1, 7))]
        if i % 5 == 0:
            lines.insert(0, rng.choice(shared))
        if i % 7 == 0:
            x = rng.choice(shared)
            lines.append(x[:5] + "q" + x[6:])
        toxic = i % 6 == 0
        if toxic:
            w = lines[-1].split()
            w[rng.randrange(len(w))] = rng.choice(CURSES if i < 140 else MISSPELT)
            lines[-1] = " ".join(w)
        docs.append(("\n".join(lines), toxic))
    for k in range(12):  # one long line each, of which one word is another in the copy
        base = line(80).split()
        docs.append((" ".join(base), False))
        docs.append((" ".join([*base[:40], "changed" + str(k), *base[41:]]), False))
    docs += [(docs[1][0], False), ("", False), (None, False), (" \n", False)]
    return [(i, t, "abc"[(i % 10 > 5) + (i % 10 > 8)], toxic) for i, (t, toxic) in enumerate(docs)]


def expected(docs):
    """(doc_id, n_tokens, ids_sha256) of every copy, by plain Python, all pairs, DuckDB's mix and the tokenizer's library."""
    rows = [(i, t, s) for i, t, s, toxic in docs if not toxic]
    first, near = brute([(i, t) for i, t, _ in rows])
    kept = [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (i, n) and x not in near)), s) for i, t, s in rows]
    texts = [t or "" for _, t, _ in kept]
    links = {p for p, x in alike_pairs(texts).items() if x >= 0.8 and texts[p[0]].split()}
    links |= {(i, j) for i, j in combinations(range(len(texts)), 2) if texts[i] == texts[j]}
    of = component_of(links, len(texts))
    kept = [r for i, r in enumerate(kept) if of[i] == i]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in kept])
    plan = con.sql(f"SELECT doc_id, size, taken FROM ({sql.op8_curriculum_mix})").fetchall()
    copies = {i: 1 if size == 0 else int(taken / size + 0.5) for i, size, taken in plan}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = []
    for i, t, _ in kept:
        ids = enc.encode_ordinary(t or "")
        out += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] * copies[i]
    return sorted(out), len(rows), len(kept)


@pytest.fixture(scope="module")
def documents():
    return made(random.Random(21))


def tables(spark, folder, docs, more=""):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s, _ in docs], SCHEMA)
    df = df.selectExpr("*", *more) if more else df
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(toxic)) for i, _, _, toxic in docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_as_brute_force(spark, documents, tmp_path):
    want, clean, kept = expected(documents)
    assert clean < len(documents) and kept <= clean - 12 and len(want) != kept
    tables(spark, str(tmp_path), documents)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == want


def test_stages_keep_columns_of_any_name(spark, documents, tmp_path):
    """Columns that have names which the operators use themselves; rows without an id; then no rows at all."""
    more = ("1 kept", "2 gone", "3 row", "4 mix_doc_id", "5 component", "6 h", "7 lines")
    rows = [*documents[:30], (None, "a line without an id " * 3, "a", False), (None, None, None, False)]
    tables(spark, str(tmp_path), rows, more)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == columns + (["mix_position"] if name == "mix" else []), name
        assert df.count() > 0 and df.where("kept = 1 and gone = 2 and row = 3 and mix_doc_id = 4 and component = 5 and h = 6 and lines = 7").count() == df.count(), name
        assert name == "mix" or df.where(F.col("doc_id").isNull()).count() == 2, name
    nothing = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
        assert nothing.count() == 0
