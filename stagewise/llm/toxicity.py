"""Toxicity by a learned lexicon, misspellings included, weighed by context.

Lexicon: words that stand in toxic texts far more often than in others, learned from a bounded sample of labelled rows. The lexicon is a trie. Levenshtein automata for all its whole
words at once are intersected with it: a state is a set of (trie node, edits so far, letter still due), made
deterministic as words ask for it, so that looking a word up takes one step a character and most words fail within a
few. Words of LEAST_FUZZY letters or more match within one edit (a letter more, less, other, or two exchanged),
shorter words exactly. A word that clean texts use themselves is no misspelling.

Each hit scores its term's weight, a misspelt one a share of it. Its window of words tells where the score goes: hits inside
quotation marks or near a word of reporting are quotations, of which a share counts, but not those near a second person:
who is addressed is not quoted. Both shares are documented priors, MISSPELT and QUOTED, and are learned instead where
LEAST_SEEN labelled rows or more hold such hits: those that make the labels likeliest. A logistic regression over the sums gives the probability.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, text_of

LEAST_FUZZY = 5
WINDOW = 6
#: Fixed cue words, in the languages of the corpus; context only, they decide nothing by themselves.
REPORTING = frozenset("said says wrote called quoted quote quotes word term phrase insult slur citation dit mot sagte schrieb wort zitat dijo palabra cita".split())
SECOND = frozenset("you your youre u ya tu vous toi du dich dein ihr tú usted vosotros".split())
QUOTES = frozenset("\"“”„«»")
#: Sums of hits' weights: outside quotations, inside, and near a second person; of words as they are, then of misspelt ones.
SUMS = ("said", "quoted", "addressed", "said_misspelt", "quoted_misspelt", "addressed_misspelt")
#: The share of its weight that a quoted hit, and a misspelt one, has where too few labelled rows tell otherwise.
QUOTED, MISSPELT = 0.4, 0.5
#: Labelled rows with such hits from which a share is learned, and the shares that are tried.
LEAST_SEEN, SHARES = 50, tuple(i / 10 for i in range(1, 11))
#: Words that a worker remembers before it starts anew.
REMEMBERED = 200_000


def bare(word: str) -> str:
    """The word in lower case without what is neither letter nor digit at its ends."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while a < b and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


Place = tuple[int, int, str]


class Automaton:
    """All Levenshtein automata of a lexicon, exchanges of neighbours included, intersected with its trie."""

    def __init__(self, words: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.fuzzy_below: list[bool] = [False]
        self.end: dict[int, str] = {}
        for t in words:
            fuzzy, node = len(t) >= LEAST_FUZZY, 0
            self.fuzzy_below[0] |= fuzzy
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.fuzzy_below.append(False)
                node = self.children[node][c]
                self.fuzzy_below[node] |= fuzzy
            self.end[node] = t
        self.states: list[frozenset[Place]] = []
        self.number: dict[frozenset[Place], int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self.state({(0, 0, "")})

    def below(self, node: int) -> list[tuple[str, int]]:
        return [(d, x) for d, x in self.children[node].items() if self.fuzzy_below[x]]

    def state(self, places: set[Place]) -> int:
        """The number of a state: places, and those that a missing letter leads on to."""
        whole = set(places)
        for node, edits, _ in places:
            if edits == 0:
                whole |= {(x, 1, "") for _, x in self.below(node)}
        key = frozenset(p for p in whole if p[1] == 0 or p[2] or (p[0], 0, "") not in whole)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.number[key]

    def step(self, state: int, c: str) -> int:
        to = self.steps[state].get(c)
        if to is None:
            places: set[Place] = set()
            for node, edits, due in self.states[state]:
                if due:  # the letter that was passed over must come now
                    if c == due:
                        places.add((node, edits, ""))
                    continue
                if c in self.children[node] and (edits == 0 or self.fuzzy_below[self.children[node][c]]):
                    places.add((self.children[node][c], edits, ""))
                if edits == 0 and self.fuzzy_below[node]:
                    places.add((node, 1, ""))  # a letter too many
                    for d, x in self.below(node):
                        places.add((x, 1, ""))  # another letter
                        places |= {(y, 1, d) for e, y in self.below(x) if e == c}  # two letters exchanged
            to = self.steps[state][c] = self.state(places)
        return to

    def match(self, word: str) -> tuple[str, str] | None:
        """(kind, term) of a lexicon word equal to this one, or of one within one edit."""
        state = self.start
        for c in word:
            state = self.step(state, c)
            if not self.states[state]:
                return None
        ends = sorted((edits, self.end[n]) for n, edits, due in self.states[state] if not due and n in self.end and (edits == 0 or len(self.end[n]) >= LEAST_FUZZY))
        return ("fuzzy" if ends[0][0] else "exact", ends[0][1]) if ends else None


class Scorer:
    """Features of texts under a lexicon: the sums of hits' scores by context."""

    def __init__(self, words: dict[str, float], innocent: frozenset[str] = frozenset()) -> None:
        self.weight = words
        self.automaton = Automaton(list(words))
        self.innocent = innocent
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, float]] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
            self.hits.clear()
        for w in words - self.seen:
            plain = bare(w)
            if (found := self.automaton.match(plain)) and (found[0] == "exact" or plain not in self.innocent):
                self.hits[w] = ("" if found[0] == "exact" else "_misspelt", self.weight[found[1]])
        self.seen |= words

    def features(self, text: str) -> list[float]:
        """The SUMS of a text."""
        words = text.lower().split()
        distinct = set(words)
        self.learn(distinct)
        sums = dict.fromkeys(SUMS, 0.0)
        if not self.hits.keys().isdisjoint(distinct):
            quotes = 0
            for i, w in enumerate(words):
                marks = sum(c in QUOTES for c in w)
                if hit := self.hits.get(w):
                    kind, weight = hit
                    near = {bare(x) for x in words[max(0, i - WINDOW) : i + WINDOW + 1]}
                    addressed = bool(near & SECOND)
                    quoted = not addressed and bool(quotes % 2 or marks == 2 or near & REPORTING)
                    sums[("quoted" if quoted else "said") + kind] += weight
                    if addressed:
                        sums["addressed" + kind] += weight
                quotes += marks
        return [sums[k] for k in SUMS]


def weighed(sums: np.ndarray, quoted: float, misspelt: float) -> np.ndarray:
    """Two columns from the SUMS of texts: all hits by their shares, and those that address someone; as logarithms."""
    plain = sums[:, :3] + misspelt * sums[:, 3:]
    return np.log1p(np.stack([plain[:, 0] + quoted * plain[:, 1], plain[:, 2]], axis=1))


class Model(NamedTuple):
    words: dict[str, float]
    innocent: frozenset[str]
    #: intercept, of all hits, of hits that address someone
    coefficients: list[float]
    quoted: float = QUOTED
    misspelt: float = MISSPELT

    def log_odds(self, sums: np.ndarray) -> np.ndarray:
        first, *rest = self.coefficients
        return first + weighed(sums.reshape(-1, len(SUMS)), self.quoted, self.misspelt) @ np.array(rest)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: those whose id's CRC-32 is divisible by 5. A null id is hashed as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most max_rows labelled rows that are not held out, the first by a hash of their ids; equal texts once."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    joined = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by max_rows
    return joined.groupBy(F.md5("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("h")


def count_terms(rows: DataFrame) -> DataFrame:
    """(term, pos, neg): texts with the word, by label."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in {bare(x) for x in text.lower().split()} - {""}:
                    n[t][toxic != 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array([x[i] for x in n.values()], pa.int64()) for i in (0, 1))], ["term", "pos", "neg"])

    return rows.mapInArrow(counted, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def misspelt(terms: DataFrame, words: list[str]) -> frozenset[str]:
    """Words of clean texts that are an edit from a lexicon word. There are fewer than the lexicon has neighbours."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(words)
        for b in batches:
            yield b.filter(pa.array([(automaton.match(t) or ("",))[0] == "fuzzy" for t in b.column(0).to_pylist()], pa.bool_()))

    return frozenset(r["term"] for r in terms.where("neg > 0").select("term").mapInArrow(near, "term string").collect())


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 400, least_texts: int = 5, least_share: float = 0.015, least_odds: float = 10.0, surely: float = 3.0
) -> Model:
    """Learn from at most max_rows labelled rows. Without any of both labels, the lexicon is empty and all scores are equal.

    Lexicon: at most max_terms words, each in least_texts toxic texts and least_share of them or more, least_odds times as
    frequent there, and `surely` times at the lower end of the 95 % interval; those in most toxic texts first.
    """
    rows = sample(docs, labels, max_rows).select("text", F.col("toxic").cast("int").alias("toxic")).cache()
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not n_pos or not n_neg:
        rows.unpersist()
        return Model({}, frozenset(), [math.log((n_pos + 0.5) / (n_neg + 0.5)), 0.0, 0.0])
    odds = F.log((F.col("pos") + 0.5) / n_pos) - F.log((F.col("neg") + 0.5) / n_neg)
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    strong = (F.col("pos") >= max(least_texts, least_share * n_pos)) & (odds >= math.log(least_odds)) & (odds - 1.96 * error >= math.log(surely))
    counted = count_terms(rows).cache()
    words = {r["term"]: r["w"] for r in counted.where(strong).orderBy(F.desc("pos"), "term").limit(max_terms).select("term", odds.alias("w")).collect()}
    innocent = misspelt(counted, list(words))
    counted.unpersist()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(words, innocent)
        for b in batches:
            x = [scorer.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array([r[i] for r in x], pa.float64()) for i in range(len(SUMS)))], ["toxic", *SUMS])

    got = rows.mapInArrow(measured, "toxic int, " + ", ".join(f"{k} double" for k in SUMS)).toPandas()
    rows.unpersist()
    sums, toxic = got[list(SUMS)].to_numpy(), (got["toxic"] == 1).to_numpy()
    quoted, misspelt_share = shares(sums, toxic)
    return Model(words, innocent, logistic(weighed(sums, quoted, misspelt_share), toxic), quoted, misspelt_share)


def shares(sums: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The shares of quoted and of misspelt hits that make the labels likeliest; the priors where fewer than LEAST_SEEN rows have such hits."""
    quoted = SHARES if (sums[:, [1, 4]].sum(axis=1) > 0).sum() >= LEAST_SEEN else (QUOTED,)
    misspelt_ones = SHARES if (sums[:, 3:].sum(axis=1) > 0).sum() >= LEAST_SEEN else (MISSPELT,)

    def likelihood(q: float, m: float) -> float:
        x = weighed(sums, q, m)
        first, *rest = logistic(x, toxic)
        z = np.clip(first + x @ np.array(rest), -30, 30)
        return float((toxic * z - np.logaddexp(0, z)).sum())

    return max(((q, m) for q in quoted for m in misspelt_ones), key=lambda x: likelihood(*x)) if len(quoted) * len(misspelt_ones) > 1 else (quoted[0], misspelt_ones[0])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> list[float]:
    """Intercept and coefficients, none of them negative, by Newton's method with a small ridge."""
    used = list(range(x.shape[1]))
    while True:
        a = np.hstack([np.ones((len(x), 1)), x[:, used]])
        w = np.zeros(a.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            return [float(w[0]), *(float(w[1 + used.index(i)]) if i in used else 0.0 for i in range(x.shape[1]))]
        used = [i for i, v in zip(used, w[1:], strict=True) if v >= 0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of (doc_id, text), whole texts.

    A null text is empty; one without hits has the score of the intercept. Rows are scored one by one, by their text
    alone: repeated rows and equal texts score alike, further columns are not read, no rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.words, model.innocent)
        for b in batches:
            p = 1 / (1 + np.exp(-np.clip(model.log_odds(np.array([scorer.features(t.as_py() or "") for t in b.column(1)])), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic. A null text is empty; rows are judged one by one, by their
    text alone; rows without an id are judged like others; no rows give no rows."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.words, model.innocent)
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array(model.log_odds(np.array([scorer.features(t.as_py() or "") for t in text])) < 0))

    return docs.mapInArrow(lean(kept), docs.schema)
