"""Operators that SQL cannot express, against plain Python on small inputs."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stagewise.llm import bpe, chat, fingerprint, linedup, mixing, neardup, quality, tokenfile, toxicity, warc
from stagewise.llm.shared import scratch

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "Hello  world\n\n\tit's 12345 fine", "naïve café ÀÉ — ½ ﬁ ß İ", "日本語テキスト", "a" * 500, "ab" * 400, "<|endoftext|> <s>", " \x0b\x1c\x85 x", "😀😀👨‍👩‍👧", "x\r\ny", "é Å", "end. end, .. a.b,c"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 120))) for _ in range(60)]
    for i in range(30):
        w = made[i].split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        made.append(" ".join(w))
    rows = list(enumerate(made + made[:10] + ODD))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_bpe_as_tiktoken(docs):
    import tiktoken

    df, rows = docs
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip(df, RANKS, PATTERN).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest()), t
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_long_words_as_tiktoken():
    """Random long words, cut and uncut; words of which the left part ranks after the whole; a word of 200,000 letters."""
    import tiktoken

    ranks = bpe.load_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = bpe.Bpe(ranks, PATTERN)
    rng = random.Random(8)
    late = [t for t, r in ranks.items() if t.isalpha() and t.isascii() and any(t[:i] in ranks and t[i:] in ranks and max(ranks[t[:i]], ranks[t[i:]]) > r for i in range(1, len(t)))]
    assert len(late) > 500
    made = ["".join(rng.choice(a) for _ in range(rng.randrange(65, 400))) for a in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "日本語中文字", "aé") for _ in range(12)]
    made += ["".join(t.decode() for t in rng.choices(late, k=rng.randrange(12, 60))) for _ in range(60)]
    made += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "a" * 100_000]
    for w, got in zip(made, b.encode(made), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == enc.encode_ordinary(w), w[:80]


def test_token_file_as_tokenizers(docs):
    from tokenizers import Tokenizer

    df, rows = docs
    t = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: r for r in tokenfile.round_trip(df, WORDS).collect()}
    start = 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)


def test_token_ids_of_odd_strings():
    """Whatever the short cuts do, ids are those of the library."""
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(WORDS), tokenfile.WordIds(WORDS)
    assert ids.by_words
    rng = random.Random(9)
    parts = ["a", "B", "İ", "ß", "É", "é", "e\u0301", "\u0301", "Σ", "ς", "ﬁ", "ŉ", "1", "²", ".", ",", "'", "'s", "'LL", " ", "\n", "\u00a0", "\u2003", "\x1c", "\x85", "日", "가", "ㄱ", "\u1161", "😀", "<|", "<|endoftext|>", "-", "_", "the", "The"]
    parts += ["ª", "µ", "º", "ÿ", "À", "×", "÷", "Ā", "%%%", '"', "(", ";", "|>", "*"]
    texts = ["İ,", "x İ.", *(f"{chr(c)}{end}" for c in range(0x250) for end in ("", "x", ".", "%\"", "'s", "\u0301")), *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(20_000))]
    for lo in range(0, len(texts), 500):
        for text, got in zip(texts[lo : lo + 500], ids.encode(texts[lo : lo + 500]), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_short_documents_are_read_alone(spark, docs):
    df, rows = docs
    folder = scratch(spark, "tokens")
    manifest = tokenfile.write(df, folder, WORDS)
    want = {r["doc_id"]: bytes(r["ids"]) for r in tokenfile.read(manifest, folder).collect()}
    name = manifest.first()["name"]
    with tokenfile.reading(f"{folder}/{name}") as f:
        shard = tokenfile.Reader(f, folder)
        i = len(shard.doc_ids) // 2
        assert shard.ids(i).astype("<u4").tobytes() == want[int(shard.doc_ids[i])]


def plain_bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates_as_all_pairs(docs):
    """Classes are those of all pairs at 0.8 or more; only pairs close to the threshold may be missed by the bands."""
    df, rows = docs
    bags = {i: plain_bag(t) for i, t in rows}
    n = len(rows)
    freq = Counter(g for b in bags.values() for g in b)
    weight = {g: 1 + np.log(n / max(f, n * neardup.SHARE, 1)) / np.log(1 / neardup.SHARE) for g, f in freq.items()}

    def alike(a, b):
        both = sum(min(a[g], b[g]) * weight[g] for g in a.keys() & b.keys())
        return both / max(sum(c * weight[g] for x in (a, b) for g, c in x.items()) - both, 1e-12)

    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    texts = dict(rows)
    n_far = 0
    for i, j in combinations(range(n), 2):
        s = alike(bags[i], bags[j])
        if s >= 0.9 or (texts[i] or "") == (texts[j] or ""):
            assert got[i] == got[j], (i, j, s)
        n_far += s < 0.5 and got[i] == got[j] and (texts[i] or "") != (texts[j] or "")
    assert n_far == 0 and all(got[i] <= i for i in got)
    kept = {r["doc_id"] for r in neardup.deduplicated(df).collect()}
    assert kept == set(got.values())


def alike_pairs(texts):
    """The weighted similarity of all pairs at 0.5 or more."""
    bags, n = [plain_bag(t) for t in texts], len(texts)
    freq = Counter(g for b in bags for g in b)
    weight = {g: 1 + np.log(n / max(f, n * neardup.SHARE, 1)) / np.log(1 / neardup.SHARE) for g, f in freq.items()}
    total = [sum(c * weight[g] for g, c in b.items()) for b in bags]
    out = {}
    for i, j in combinations(range(n), 2):
        both = sum(min(bags[i][g], bags[j][g]) * weight[g] for g in bags[i].keys() & bags[j].keys())
        if both > 0 and 3 * both >= total[i] + total[j] - both:
            out[i, j] = both / (total[i] + total[j] - both)
    return out


def component_of(links, n):
    of = list(range(n))
    for i, j in sorted(links):
        a, b = of[i], of[j]
        of = [min(a, b) if x in (a, b) else x for x in of]
    return of


def clusters(seed, copies=60):
    """Copies of three texts with up to eleven words replaced, so that many pairs lie on both sides of the threshold."""
    rng = random.Random(seed)
    made = []
    for c in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range((90, 150, 40)[c])]
        for k in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, (6, 12, 3)[c])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            made.append(" ".join(w[: len(w) - rng.randrange(0, 12)]))
    return list(dict.fromkeys(made))


@pytest.mark.parametrize("small", [2, 6])
def test_classes_of_large_groups_are_those_of_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "LEADER_ROUNDS", 1)
    texts = clusters(4)
    near = alike_pairs(texts)
    want = component_of([p for p, s in near.items() if s >= 0.8 - 1e-9], len(texts))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(want)) > 20 and [got[i] for i in range(len(texts))] == want


def test_pairs_just_above_the_threshold_meet(spark):
    """Of pairs between 0.8 and 0.9 at least 0.99 share a bucket: the recall that the bands are chosen for, measured."""
    texts = clusters(5, 150)
    near = [p for p, s in alike_pairs(texts).items() if 0.8 <= s < 0.9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = spark.sparkContext.broadcast(neardup.idf_weights(docs, 5))
    bands = {r["doc_id"]: r["bands"] for r in neardup.signatures(docs, 5, weights).collect()}
    met = sum(any(x == y for x, y in zip(bands[i], bands[j], strict=True)) for i, j in near)
    assert len(near) > 400 and met >= 0.99 * len(near)


def test_weights_depend_on_shares_of_documents_alone(spark):
    """With many more shingles than cells a shingle's weight is still that of its own count."""
    rows = [(i, " ".join([f"r{i}x{j}" for j in range(40)] + (["a", "b", "c", "d", "e"] if i % 4 == 0 else []))) for i in range(3000)]
    got = {}
    for copies in (1, 3):
        docs = spark.createDataFrame([(k * 3000 + i, t.replace("r", f"r{k}")) for k in range(copies) for i, t in rows], "doc_id long, text string")
        weights = neardup.idf_weights(docs, 5)
        terms = neardup.bags(pa.array(["a b c d e", "none of these stands anywhere"]), 5)
        got[copies] = weights.of(terms.hashes).tolist()
    assert got[1] == pytest.approx(got[3]) and got[1][0] == pytest.approx(1 + np.log(4) / np.log(1024), rel=1e-3) and got[1][1] == pytest.approx(2, rel=1e-3)


def test_texts_that_share_an_id_and_rows_without_one(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, b), (None, a), (3, "c " * 30), (None, "alone in the world of texts"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, component int, gone int")
    got = sorted(((r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (3, 3), (None, None), (4, 4), (5, 4)], key=str)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "3", "4", "None", "None"]


def test_lone_weak_links_join_classes(spark):
    """A chain whose neighbours are alike is one class although its ends are not."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[: 200 + 3 * k])) for k in range(40)]
    got = {r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def edits(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_as_edit_distance():
    """Edits are letters more, less or other, and neighbours exchanged."""

    rng = random.Random(1)
    lexicon = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))) for _ in range(60)})
    automaton = toxicity.Automaton(lexicon)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 10)))
        found = automaton.match(w)
        near = [t for t in lexicon if edits(w, t) <= (len(t) >= toxicity.LEAST_FUZZY)]
        assert (found is None) == (not near), (w, near, found)
        if found:
            assert found[0] == ("exact" if w in lexicon else "fuzzy") and found[1] in near


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        w = [rng.choice(plain) for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = rng.choice(["grobnik", "flimzard", "rgobnik", "xlimzard", "frobnik"] if i % 3 else ["grobnik", "flimzard"])
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    got = toxicity.score(docs, model).join(known, "doc_id").where("held_out").collect()
    assert got and all(r["predicted"] == r["toxic"] for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert {r["doc_id"] for r in toxicity.accepted(docs, model).collect()} >= {r["doc_id"] for r in got if not r["toxic"]}
    assert set(model.words) >= {"grobnik", "flimzard"}
    unseen = spark.createDataFrame([(10**6 + i, f"word1 word2 {w} word3") for i, w in enumerate(["gorbnik", "grobnki", "lfimzard", "limzard", "zgrobnik", "word7"])], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score(unseen, model).orderBy("doc_id").collect()] == [1, 1, 1, 1, 1, 0]
    scorer = toxicity.Scorer({"flimzard": 2.0}, frozenset(["flimward"]))
    quoted, direct, plain = (scorer.features(t) for t in ('they said "flimzard" here', "you are flimzard here", "a flimzard here"))
    assert quoted[0] == 0 < quoted[1] and direct[0] == plain[0] > 0 and direct[2] > 0 == plain[2]
    assert scorer.features("a lfimzard here")[3] > 0 == scorer.features("a flimward here")[3]


def plain_sums(text, lexicon, innocent):
    """SUMS of a text, word by word, every word held against every term."""
    words, sums, quotes = text.lower().split(), dict.fromkeys(toxicity.SUMS, 0.0), 0
    for i, w in enumerate(words):
        marks, word = sum(c in toxicity.QUOTES for c in w), toxicity.bare(w)
        close = sorted(t for t in lexicon if len(t) >= toxicity.LEAST_FUZZY and edits(word, t) <= 1)
        kind, term = ("", word) if word in lexicon else ("_misspelt", close[0]) if close and word not in innocent else ("", None)
        if term:
            near = {toxicity.bare(x) for x in words[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1]}
            if near & toxicity.SECOND:
                sums["said" + kind] += lexicon[term]
                sums["addressed" + kind] += lexicon[term]
            else:
                sums[("quoted" if quotes % 2 or marks == 2 or near & toxicity.REPORTING else "said") + kind] += lexicon[term]
        quotes += marks
    return [sums[k] for k in toxicity.SUMS]


def test_sums_and_scores_against_a_plain_walk(spark):
    rng = random.Random(21)
    lexicon, innocent = {"flimzard": 2.0, "grob": 1.5, "grobnik": 3.0}, frozenset(["flimward"])
    parts = ["flimzard", "flimzrad", "limzard", "flimward", "grob", "grub", "grobnik,", "gorbnik", "you", "said", '"', '"grob"', "a", "b", "the", "of", "c", "Flimzard!", "d", "e"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(400)]
    scorer, model = toxicity.Scorer(lexicon, innocent), toxicity.Model(lexicon, innocent, [-2.0, 1.5, 0.5], 0.3, 0.6)
    plain = [plain_sums(t, lexicon, innocent) for t in texts]
    assert [scorer.features(t) for t in texts] == plain
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, (a, b, c, d, e, f) in enumerate(plain):
        z = -2.0 + 1.5 * np.log1p(a + 0.6 * d + 0.3 * (b + 0.6 * e)) + 0.5 * np.log1p(c + 0.6 * f)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-12
    assert len({tuple(x > 0 for x in p) for p in plain}) > 12


def test_shares_are_priors_until_enough_rows_tell():
    rng = np.random.default_rng(1)
    sums = np.zeros((2000, 6))
    sums[:400, 0], sums[400:420, 1] = 2, 2
    toxic = rng.random(2000) < np.where(sums[:, 0] > 0, 0.95, np.where(sums[:, 1] > 0, 0.5, 0.05))
    assert toxicity.shares(sums, toxic) == (toxicity.QUOTED, toxicity.MISSPELT)
    sums[400:800, 1] = 2  # as toxic as if said
    toxic[400:800] = rng.random(400) < 0.95
    assert toxicity.shares(sums, toxic)[0] >= 0.8
    toxic[400:800] = rng.random(400) < 0.05  # as clean as if nothing were said
    assert toxicity.shares(sums, toxic)[0] == toxicity.SHARES[0]


def test_toxicity_on_held_out_labels(spark):
    """AUC and recall on rows of the driver's table that were never learned from."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where(toxicity.held_out()).select("text", "toxic").collect()
    scorer = toxicity.Scorer(model.words, model.innocent)
    got = model.log_odds(np.array([scorer.features(r["text"] or "") for r in rows]))
    toxic = np.array([r["toxic"] == 1 for r in rows])
    auc = (got[toxic][:, None] > got[~toxic][None]).mean() + (got[toxic][:, None] == got[~toxic][None]).mean() / 2
    recall, specificity = (got[toxic] >= 0).mean(), (got[~toxic] < 0).mean()
    print(f"AUC {auc:.3f}, recall {recall:.3f}, specificity {specificity:.3f}")
    assert auc >= 0.96 and recall >= 0.92 and specificity >= 0.99
    word = next(iter(model.words))
    plain, quoted, direct, evading = (float(model.log_odds(np.array(scorer.features(t)))[0]) for t in (word, f'they said "{word}" in the report', f"you are {word}", f"you are, as they said, {word}"))
    assert model.coefficients[0] < quoted < 0 < plain < direct and evading == direct  # a quotation counts less, but not nothing


def test_fingerprints_and_edits(docs):
    df, rows = docs
    got = {r["doc_id"]: r for r in fingerprint.search(df, every=10).collect()}
    texts = [t or "" for _, t in rows]
    for i, t in enumerate(texts):
        after = texts[i - 1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        prints = fingerprint.simhash(pa.array([t, edited, after]))
        a, b = prints[:1], prints[1:]
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == tuple(fingerprint.hexes(prints[:2]))
        assert [got[i]["near_edited"], got[i]["near_next"]] == pytest.approx(list(fingerprint.likeness(np.repeat(a, 2, 0), b)))
    number = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    for i in got:
        want = sum((number[i] ^ number[j]).bit_count() <= 3 for j in got if j != i)
        assert got[i]["n_within"] == (want if i % 10 == 0 else None)


def test_templates_that_rewrite_history_are_found(spark):
    def forgetful(turns):
        return "".join(f"[{r}:{t}]" for r, t in turns[-2:])

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def reader(span):
        role, text = span[1:-1].split(":")
        return role, text, len(role) + 2, len(span) - 1

    got = {r["conv_id"]: r for r in chat.format_turns(df, forgetful, reader).collect()}
    assert not got[1]["rewrites_history"] and got[2]["rewrites_history"]
    assert got[1]["formatted"][got[1]["spans"][1]["text_start"] : got[1]["spans"][1]["text_end"]] == "b"


def test_escapes_come_back():
    rng = random.Random(4)
    parts = [*chat.CONTROL, "\\", "\n", "<", "|", ">", "x", "[", "/", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        role = "".join(rng.choice(parts) for _ in range(rng.randrange(4)))
        assert chat.read_turn(chat.marked([(role, text)]))[:2] == (role, text)
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_records_are_found_by_frame_and_offset(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i + 1)) for i in range(50)]
    folder = scratch(spark, "warc")
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, frame_bytes=500)
    for r in index.where("page_id % 7 = 0").collect():
        head, body = warc.lookup(folder, r["name"], r["frame"], r["offset"])
        assert head["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>" and body.decode() == rows[r["page_id"]][2]
    assert index.select("frame").distinct().count() > 1
    with warc.reading(f"{folder}/{index.first()['name']}") as file:
        at, size = warc.seek_table(file)[0]
        file.seek(at)
        assert file.read(size)[4:] and warc.parse(warc.zstandard.ZstdDecompressor().decompress((file.seek(at), file.read(size))[1]))[0]["WARC-Type"] == "warcinfo"
    read = warc.read(index, folder)
    assert read.rdd.getNumPartitions() > 1 and sum(n > 0 for n in read.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 1


def test_the_order_of_rules_changes_no_verdict(docs):
    df, rows = docs
    first = {r["doc_id"]: r["kept"] for r in quality.assess(df, quality.FURTHER).collect()}
    last = {r["doc_id"]: r["kept"] for r in quality.assess(df, quality.FURTHER[::-1], sample_rows=1).collect()}
    assert first == last
    for i, t in rows:
        assert first[i] == all(not rule.rejects(quality.Text(t)) for rule in (*quality.BASE, *quality.FURTHER))


def test_rules_are_ordered_by_what_they_add():
    """A rule that rejects as much comes first if its measures are cheaper, or made already; one that adds nothing comes last."""
    a, b, c, d = (quality.Rule(n, needs, None) for n, needs in (("a", ("x",)), ("b", ("y",)), ("c", ("x", "z")), ("d", ("y",))))
    seconds, rejected = {"x": 4.0, "y": 1.0, "z": 0.5}, {0b0001: 10, 0b1010: 20, 0b0100: 5}
    assert [r.name for r in quality.in_order([a, b, c, d], seconds, rejected)] == ["b", "a", "c", "d"]


def test_mix_meets_its_targets(docs):
    df, rows = docs
    df = df.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")))
    got = mixing.mix(df).collect()
    assert got == mixing.mix(df.repartition(7)).collect()
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    positions = [r["position"] for r in got if r["position"] is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
