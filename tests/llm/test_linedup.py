import random

import pytest
from pyspark.sql import functions as F

from stagewise.llm import linedup

WORD = "abcdefghij klmnop"


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def changed(rng: random.Random, s: str, n: int) -> str:
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + "x" + s[i:], s[:i] + s[i + 1 :], s[:i] + "é" + s[i + 1 :]])
    return s


def test_band_agrees_with_the_whole_matrix(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
        rows.append((a, changed(rng, a, rng.randrange(0, 5))))
    for k in (1, 2, 3):
        near = [r for r in rows if abs(len(r[0]) - len(r[1])) <= k]
        df = spark.createDataFrame(near, "a string, b string")
        chars = [F.filter(F.split(c, ""), lambda x: x != "") for c in "ab"]
        for r in df.withColumn("ok", linedup.within_edits(*chars, k)).collect():
            assert r["ok"] == (edits(r["a"], r["b"]) <= k), (r, k)


def brute(docs, max_edits=2, least=20):
    lines = sorted((i, n, x) for i, t in docs for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\v\f"))
    first = {}
    for i, n, x in lines:
        first.setdefault(x, (i, n))
    near = {x for x, at in first.items() if len(x) >= least and any(o < at and len(y) >= least and edits(x, y) <= max_edits for y, o in first.items() if abs(len(x) - len(y)) <= max_edits)}
    return first, near


def test_lines_dropped_are_those_of_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice(WORD) for _ in range(rng.randrange(20, 40))) for _ in range(12)]
    docs = []
    for i in range(60):
        lines = [changed(rng, rng.choice(base), rng.randrange(0, 4)) for _ in range(rng.randrange(1, 6))] + rng.choice([[], ["ok"], ["", "ok"]])
        docs.append((i, "\n".join(lines)))
    docs += [(90, None), (91, ""), (92, " \n\t")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("line", F.lit("clash"))
    first, near = brute(docs)
    got = {r["doc_id"]: r for r in linedup.report(df).collect()}
    texts = {r["doc_id"]: r for r in linedup.deduplicated(df).collect()}
    assert len(near) > 10
    for i, t in docs:
        kept = [x for n, x in enumerate((t or "").split("\n")) if not x.strip() or (first[x] == (i, n) and x not in near)]
        assert got[i]["n_kept"] == sum(bool(x.strip()) for x in kept), i
        assert texts[i]["text"] == (None if t is None else "\n".join(kept)), i
        assert texts[i]["n_chars"] == len("\n".join(kept)) and texts[i]["line"] == "clash"


def family(rng, n):
    """Lines that share long segments: some differ in a number, some by edits of one line, some in words."""
    base = "the quick brown fox jumps over a lazy dog and runs"
    made = [f"Order number {rng.randrange(300)} has left the store in town" for _ in range(n)]
    made += [changed(rng, base, rng.randrange(0, 5)) for _ in range(n)]
    made += ["aaaaaaaaaaaaaaaaaaaa" + "a" * rng.randrange(8) + rng.choice(["", "b", "bb"]) + "a" * rng.randrange(4) for _ in range(n // 3)]
    for _ in range(n):
        w = base.split()
        w[rng.randrange(len(w))] = "".join(rng.choice("abcxyz") for _ in range(rng.randrange(1, 6)))
        made.append(" ".join(w))
    rng.shuffle(made)
    return made


@pytest.mark.parametrize(("bucket", "max_edits"), [(0, 2), (0, 1)])
def test_full_keys_are_refined_to_the_same_result(spark, monkeypatch, bucket, max_edits):
    """With small buckets every step of the refinement is reached; the result is that of all pairs."""
    monkeypatch.setattr(linedup, "BUCKET", bucket)
    rng = random.Random(11 + bucket)
    docs = [(i, x) for i, x in enumerate(family(rng, 45))]
    first, near = brute(docs, max_edits)
    order = sorted(first, key=first.get)
    want = {first[x][0]: next((first[y][0] for y in order if first[y] < first[x] and len(y) >= 20 and edits(x, y) <= max_edits), None) if len(x) >= 20 else None for x in order}
    got = {r["doc_id"]: r for r in linedup.report(spark.createDataFrame(docs, "doc_id long, text string"), max_edits).collect()}
    for i, x in docs:
        assert got[i]["n_equal"] == (first[x][0] != i)
        assert (got[i]["n_near"], got[i]["near_doc"]) == ((1, want[i]) if first[x][0] == i and want[i] is not None else (0, None)), (x, got[i])
    assert sum(r["n_near"] for r in got.values()) == len(near) > 20


def test_rows_stay_in_proportion_in_a_large_family(spark):
    """Near copies of one line, each with two other words: all pairs would be 16 times as many in four times the lines."""

    def made(n):
        rng = random.Random(3)
        words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
        texts = []
        for _ in range(n):
            w = list(words)
            for _ in range(2):
                w[rng.randrange(15)] = "".join(rng.choice("abcdefgh") for _ in range(6))
            texts.append(" ".join(w))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        lines = linedup.split_lines(docs).select(F.xxhash64("line").alias("lid"), "line").withColumns({"odd": linedup.parity(F.split("line", "")), "odd_pairs": linedup.pair_parity(F.split("line", ""))}).cache()
        own = (F.col("less") == 0) & (F.col("shift") == 0)
        rows = linedup.met(linedup.keyed(lines, 2), own)
        parted = linedup.met(linedup.parted(rows.where(F.col("n_own") > linedup.BUCKET), lines, 2), own)
        left = linedup.first_stretches(parted.where(F.col("n_own") > linedup.BUCKET), lines, 2).count()
        return left, sum(linedup.pairs_of(r, own, lines, 2).count() for r in (rows, parted))

    few, many = made(1000), made(4000)
    assert many[0] <= 4 * few[0] + 4000 and many[1] <= 8 * few[1] + 4000
    assert many[1] < 4000 * 3999 / 20


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert linedup.report(empty).count() == 0 and linedup.deduplicated(empty).count() == 0
    long = "word " * 30_000
    rows = [(None, "a line of more than twenty"), (1, "a line of more than twenty"), (1, "a line of more than twenty"), (2, long), (3, long + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_equal"], r["n_near"], r["n_kept"]) for r in linedup.report(df).collect()}
    assert got == {None: (1, 0, 0, 1), 1: (1, 1, 0, 0), 2: (1, 0, 0, 1), 3: (1, 0, 1, 0)}
    assert linedup.deduplicated(df).count() == 5
    clash = df.selectExpr("doc_id", "text", "1 kept", "2 number", "3 row", "4 numbers")
    assert linedup.deduplicated(clash).columns == clash.columns and linedup.deduplicated(clash).where("kept = 1 and number = 2 and row = 3 and numbers = 4").count() == 5
