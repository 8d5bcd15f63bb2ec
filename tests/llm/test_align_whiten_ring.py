"""Alignment of tokenizers, whitening, and pigeonring near-duplicates against plain Python and numpy."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from stagewise.llm import align, pigeonring, whitening

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a", "a  b   c ", "x\n y \n\n z", "it's 12345 — naïve café", "日本語 テキスト", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁ x", "\x00 nul", "tab\tand\x1c x", "😀 👨‍👩‍👧", "  nbsp 　x", "é é", "a\r\nb", "word " * 3000]


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    alphabet = align.byte_alphabet()

    def b_bytes(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode()

    rows, links = [], []
    for t in texts:
        ids_a = first.encode(f" {t}", add_special_tokens=False).ids if t else []
        ids_b = second.encode(t) if t else []
        raw_a = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in ids_a]
        raw_b = [b_bytes(i) for i in ids_b]
        if not t or b"".join(raw_a) != f" {t}".encode() or b"".join(raw_b) != f" {t}".encode():
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = ({int(e): k for k, e in enumerate(np.cumsum([len(x) for x in raw]))} for raw in (raw_a, raw_b))
        both, groups, i, j = sorted(ends_a.keys() & ends_b.keys()), [], 0, 0
        for e in both:
            groups.append(",".join(map(str, ids_a[i : ends_a[e] + 1])) + "|" + ",".join(map(str, ids_b[j : ends_b[e] + 1])))
            i, j = ends_a[e] + 1, ends_b[e] + 1
        rows.append((len(ids_a), len(ids_b), len(both), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append([(ids_a[ends_a[e]], ids_b[ends_b[e]]) for e in both])
    count = Counter(x for found in links for x in found)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(*r[:3], r[2], sum(count[x] == best[x[1]] for x in found), sum(count[x] for x in found), r[3]) for r, found in zip(rows, links, strict=True)], count, best


@pytest.mark.parametrize("width", [1, 32])
def test_alignment_against_plain_python(spark, width):
    rng = random.Random(5)
    words = ["the", "of", "naïve", "ing,", "x.\nAs", "12", "über", "señor", "$$$", "本"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += texts[-3:]
    rows = [(i if i % 9 else None, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    plain, count, best = plain_alignment(texts)
    got = Counter((r["doc_id"], *(r[n] for n in names)) for r in align.alignment(df, A, B, width).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, plain, strict=True))
    if width > 1:
        links = {(r["a"], r["b"]): r["count"] for r in align.best_links(df, A, B, width).collect()}
        assert links == {x: n for x, n in count.items() if n == best[x[1]]}


def test_alignment_of_no_documents(spark):
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_real_documents_align_as_in_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    plain, _, _ = plain_alignment(list(texts.values()))
    got = {r["doc_id"]: tuple(r)[1:] for r in align.alignment(docs, A, B).collect()}
    assert got == dict(zip(texts, plain, strict=True))


def test_pieces_are_those_of_whole_texts():
    """Random texts of awkward characters: cut or not, both tokenizers give the same."""
    rng = random.Random(11)
    made = ["".join(rng.choice(["a", "b", " ", " ", "\n", "\t", ".", "é", "▁", "'s", "9", " ", "-", "Ab"]) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    cut, whole = align.Aligner(A, B), align.Aligner(A, B)
    assert cut.cuts
    whole.cuts = False
    x, y = cut.texts(made), whole.texts(made)
    assert x.groups == y.groups and x.n_a == y.n_a and x.n_b == y.n_b and x.a.tolist() == y.a.tolist() and x.b.tolist() == y.b.tolist()


def test_hot_stripes_go_to_several_tasks():
    weights = {0: 50_000, **{i: 50 for i in range(1, 1000)}}
    places = align.dealt(weights, 20)
    load = Counter()
    for stripe, to in places.items():
        for i in to:
            load[i] += weights[stripe] / len(to)
    assert set(places) == set(weights) and len(places[0]) >= 10 and max(load.values()) <= 2 * sum(weights.values()) / 20
    assert align.dealt({}, 4) == {}


def plain_whitening(vectors, k=4):
    x = [tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(v) for v in x)
    x = [v for v in x if len(v) == d]
    fit = np.array(sorted(set(x)), float)
    v = np.cov(fit.T, bias=True)
    e, w = np.linalg.eigh(v)
    order = np.argsort(-e)[:k]
    n, sums = len(fit), fit.astype(int).sum(axis=0).tolist()
    white = (np.array(x, float) - fit.mean(axis=0)) @ w[:, order] / np.sqrt(e[order])
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x], white, e[order] / np.trace(v)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]
    vectors = [*base.tolist(), *base[:40].tolist(), None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], []]
    df = spark.createDataFrame([(i, v, i) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x int")
    n, deviations, white, explained = plain_whitening(vectors)
    got = {}
    for r in whitening.whitened(df).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(got) == list(range(240)) and all(sorted(c) == [1, 2, 3, 4] for c in got.values())
    mine = np.array([[got[i][c]["whitened"] for c in (1, 2, 3, 4)] for i in range(240)])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine * sign, white, rtol=1e-9, atol=1e-9)
    for i in range(240):
        assert got[i][1]["n"] == n and got[i][1]["deviation"] == deviations[i]
        assert abs(got[i][3]["explained"] - explained[2]) < 1e-9 and got[i][1]["identity_error"] < 1e-9


def test_whitening_of_awkward_tables(spark):
    def of(rows):
        return whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()

    assert of([]) == [] and of([(1, None), (2, [None])]) == []
    same = of([(1, [0.5, 1.0]), (None, [0.5, 1.0])])  # no variance: nothing can be scaled to one
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 for r in same)
    flat = of([(i, [float(i), 2.0, 0.0]) for i in range(5)])  # one dimension varies
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and flat[0]["explained"] == 1.0
    exact = of([(i, [i * 2e6, 1.0]) for i in range(3)])  # in decimals, beyond what doubles hold
    assert {r["deviation"] for r in exact} == {(3 * 512_000_000) ** 2, 0}
    far = of([(i, [i * 2e7, 1.0]) for i in range(3)])  # beyond 64 bits
    assert {r["deviation"] for r in far} == {None, 0}


def plain_print(text, words=3):
    said = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    runs = [said[i : i + words] for i in range(max(1, len(said) - words + 1))] if said else []
    votes = [0] * 64
    for run in runs:
        h = xxhash.xxh64(b" ".join(run), seed=42).intdigest()
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(runs))


def plain_classes(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def near_prints(rng, n=40):
    """Random ones, and clouds of numbers around some that chain on in steps of up to three bits."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(n):
            x = (x if rng.random() < 0.6 else out[-1]) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            out.append(x)
    return list(dict.fromkeys(out)) + [0, 1, 3, 7, 2**63, 2**64 - 1]


@pytest.mark.parametrize("small,segments", [(256, 5), (1, 5), (3, 3), (8, 9)])
def test_links_connect_all_pairs_in_the_radius(spark, small, segments):
    prints = list(dict.fromkeys(near_prints(random.Random(small))))
    df = spark.createDataFrame([(pigeonring.signed(p),) for p in prints], "print long")
    got = [(r["u"] % 2**64, r["v"] % 2**64) for r in pigeonring.links(df, 2, segments, small).collect()]
    assert all((u ^ v).bit_count() <= 2 for u, v in got)
    wanted = {(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2}
    if small == 256:
        assert {frozenset(x) for x in got} == {frozenset(x) for x in wanted}
    position, parent = {p: i for i, p in enumerate(prints)}, list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in got:
        a, b = sorted((root(position[u]), root(position[v])))
        parent[b] = a
    assert [root(i) for i in range(len(prints))] == plain_classes(prints)


def test_larger_and_odd_radius(spark):
    rng = random.Random(9)
    prints = near_prints(rng, 15)
    df = spark.createDataFrame([(pigeonring.signed(p),) for p in set(prints)], "print long")
    for radius, segments, small in ((3, 7, 256), (1, 3, 2), (4, 6, 256)):
        got = {frozenset((r["u"] % 2**64, r["v"] % 2**64)) for r in pigeonring.links(df, radius, segments, small).collect()}
        assert got == {frozenset(x) for x in combinations(set(prints), 2) if (x[0] ^ x[1]).bit_count() <= radius}
    with pytest.raises(ValueError, match="radius"):
        pigeonring.links(df, 5, 5)


@pytest.mark.parametrize("small", [256, 1])
def test_near_classes_against_all_pairs(spark, small):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 400))) for _ in range(40)]
    for t in texts[:25]:
        w = t.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += texts[:5] + ["", None, " \t\n", "one", "ONE", "one two", "One Two", "É é", "é é", "x y z\x1cw", "word " * 20_000, texts[0].upper()]
    rows = [(i * 7 % 1000 if i % 11 else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, print string")
    prints = [plain_print(t) for t in texts]
    roots, least = plain_classes(prints), {}
    for (key, _, _), r in zip(rows, roots, strict=True):
        if key is not None:
            least[r] = min(least.get(r, key), key)
    wanted = Counter((key, f"{p:016x}", least.get(r)) for (key, _, _), p, r in zip(rows, prints, roots, strict=True))
    got = Counter(tuple(r) for r in pigeonring.near_classes(df, small=small).collect())
    assert got == wanted and len(set(roots)) < len(set(prints))


def test_near_classes_of_no_documents(spark):
    assert pigeonring.near_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_real_documents_have_the_classes_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    prints = [plain_print(r["text"]) for r in rows]
    roots = plain_classes(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in pigeonring.near_classes(docs).collect()} == {r["doc_id"]: (f"{p:016x}", rows[k]["doc_id"]) for r, p, k in zip(rows, prints, roots, strict=True)}


def test_spark_hashes_terms_alike(spark):
    """The hash of a term is the one that Spark's own function gives."""
    terms = ["a b c", "é ü ñ", "", "x" * 40]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.xxhash64("t")).collect()]
    assert [x % 2**64 for x in got] == [xxhash.xxh64_intdigest(t.encode(), pigeonring.SEED) for t in terms]
