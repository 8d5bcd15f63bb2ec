"""What the operators once left out, against plain Python on small inputs."""

import hashlib
import math
import random
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from stagewise.llm import fingerprint, mixing, queries


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]


def test_edited_copies_are_partners(spark, words, tmp_path):
    """Texts of 100 words and copies with one word replaced find each other, by id, as all pairs within the radius do."""
    rng = random.Random(6)
    rows, copies = [], {}
    for k in range(12):
        base = [rng.choice(words) for _ in range(100)]
        rows.append((100 * k, " ".join(base)))
        for j in range(1, 6):
            w = list(base)
            w[rng.randrange(100)] = f"new{k}x{j}"
            rows.append((100 * k + j, " ".join(w)))
            copies[100 * k + j] = 100 * k
        rows.append((100 * k + 50, " ".join(base)))
    rows += [(None, rows[0][1]), (None, None), (7000, None), (7001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_simhash(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    number = [int(r["fingerprint"], 16) for r in got]
    first = {n: min((r["doc_id"] for r, m in zip(got, number) if m == n and r["doc_id"] is not None), default=None) for n in number}
    for r, n in zip(got, number):
        assert r["first_id"] == first[n]
        near = [m for m in number if (m ^ n).bit_count() <= fingerprint.RADIUS]
        if r["doc_id"] is not None and r["doc_id"] % 100 == 0:
            assert r["n_within"] == len(near) - 1
            assert r["partners"] == sorted({first[m] for m in near} - {None})
        else:
            assert r["n_within"] is None and r["partners"] is None
    by_id = {r["doc_id"]: r for r in got}
    assert sum(by_id[i]["first_id"] in by_id[k]["partners"] for i, k in copies.items()) >= 0.9 * len(copies)


@pytest.mark.parametrize(("radius", "blocks"), [(0, 4), (3, 6), (9, 5), (14, 5), (17, 6)])
def test_search_is_exact_at_any_radius(spark, radius, blocks):
    rng = random.Random(radius)
    made = [rng.getrandbits(128) for _ in range(20)]
    for x in made[:20]:
        for n in range(0, 22, 2):
            made.append(x ^ sum(1 << i for i in rng.sample(range(128), n)))
    df = spark.createDataFrame([(f"{x:032x}",) for x in made], "fingerprint string")
    asked = df.where(F.substring("fingerprint", 1, 1) < "8")
    got = [(int(r["query"], 16), int(r["fingerprint"], 16), r["distance"]) for r in fingerprint.within(asked, df, radius, blocks).collect()]
    want = {(a, b, (a ^ b).bit_count()) for a in made if a >> 127 == 0 for b in made if (a ^ b).bit_count() <= radius}
    assert len(got) == len(want) and set(got) == want


def test_schedules_are_followed(spark, words):
    """Positions along schedules of straight lines, with a time without any weight, against a plain integral."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 20))), "ab"[i % 2]) for i in range(120)]
    given = {"a": [(0, 0), (0.25, 4), (0.5, 0), (0.75, 0), (1, 2)], "b": [(0, 1), (1, 1)]}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), schedules=given).collect()

    def weight(points, u):
        (x, a), (y, b) = next((p, q) for p, q in zip(points, points[1:], strict=False) if u <= q[0])
        return a + (b - a) * (u - x) / (y - x)

    steps = 20_000
    for source, points in given.items():
        w = [weight(points, (k + 0.5) / steps) for k in range(steps)]
        before, k, area = 0, 0, 0.0
        for r in sorted((r for r in got if r["source"] == source), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
            while k < steps and area < before / r["target"] * sum(w):
                area, k = area + w[k], k + 1
            assert r["position"] is None or r["position"] == pytest.approx(k / steps, abs=2e-2 if before == 0 else 2e-3)
            assert r["position"] is None or not (source == "a" and 0.501 < r["position"] < 0.749)
            before += r["size"]


def test_every_copy_has_its_own_position(spark, words):
    """A source that is taken several times is due all along its demand, one pass after another, and rows come in that order."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))), "abc"[(i > 150) + (i > 170)]) for i in range(200)]
    rows += [(200, "", "a"), (201, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    want, last = {}, {}
    for k, source in enumerate("abc"):
        tilt, before = 0.8 * (k - 1), 0
        for i in sorted((i for i, _, s in rows if s == source), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            r = plan[i]
            for n in range(int(r["taken"] / r["size"] + 0.5) if r["size"] else 0):
                x = (n * r["source_size"] + before) / r["target"]
                want[i, n] = x if tilt == 0 else (tilt - 1 + math.sqrt((1 - tilt) ** 2 + 4 * tilt * x)) / (2 * tilt)
                last[source] = max(last.get(source, 0), want[i, n])
            before += r["size"] or 0
    out = mixing.resample(df, position="due").collect()
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append(r["due"])
    assert got.pop(200) == got.pop(201) == [None]
    assert {(i, n): x for i, due in got.items() for n, x in enumerate(due)} == pytest.approx(want)
    placed = [r["due"] for r in out if r["due"] is not None]
    assert placed == sorted(placed) and all(r["due"] is None for r in out[len(placed) :])
    assert max(len(due) for due in got.values()) == 3 and min(last.values()) > 0.8
    encoded = corpus_pipeline.encoded(spark, corpus_pipeline.mixed(spark, df, ""), "").collect()
    assert sorted(x for r in encoded if (x := r["mix_position"]) is not None) == pytest.approx(placed)
