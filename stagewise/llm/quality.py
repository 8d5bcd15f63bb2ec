"""Quality rules as a short-circuit cascade.

Each rule is a cheap test of some measures of one text. On a sample of bounded size every measure is timed, and it is
noted which rules reject each text. The rules, those of the base verdict among them, are then put in order one after
another: next comes the one that rejects most of the sample's texts that are left, for each second that its measures
cost beyond those already made. A document meets no further rule once one has rejected it. The order changes what a run
costs, never which documents it keeps: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
LETTER = re.compile(r"[^\W\d_]")


class Text:
    """One text; what rules ask for is computed when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    def __getattr__(self, name: str):
        value = MEASURES[name](self)
        setattr(self, name, value)
        return value


def repeat_words(words: list[str]) -> int:
    """Words inside a 3-word window that occurs twice or more in the text, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set[tuple] = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def dup_lines(lines: list[str]) -> int:
    return len(lines) - len(set(lines))


MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: WORDS.findall(t.text),
    "lines": lambda t: [x for x in t.text.split("\n") if WORDS.search(x)],
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: sum(map(len, t.words)),
    "n_symbols": lambda t: len(SYMBOLS.findall(t.text)),
    "n_dup_lines": lambda t: dup_lines(t.lines),
    "n_repeat_words": lambda t: repeat_words(t.words),
    "n_lettered": lambda t: sum(1 for w in t.words if LETTER.search(w)),
    "n_upper": lambda t: sum(1 for c in t.text if c.isupper()),
}


class Rule(NamedTuple):
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Text], bool]


#: The rules of the base verdict.
BASE = (
    Rule("few_words", ("words", "n_words"), lambda t: t.n_words < 50),
    Rule("repeated_windows", ("words", "n_words", "n_repeat_words"), lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
#: The further rules, after what published web-corpus filters use.
FURTHER = (
    Rule("symbols", ("words", "n_words", "n_symbols"), lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", ("words", "n_words", "word_chars"), lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("duplicate_lines", ("lines", "n_dup_lines"), lambda t: 10 * t.n_dup_lines > 3 * len(t.lines)),
    Rule("letters", ("words", "n_words", "n_lettered"), lambda t: 10 * t.n_lettered < 7 * t.n_words),
    Rule("capitals", ("words", "word_chars", "n_upper"), lambda t: 2 * t.n_upper > t.word_chars),
)


def trial(texts: Sequence[str | None], rules: Sequence[Rule]) -> tuple[dict[str, float], Counter[int]]:
    """Seconds that each measure took over the texts, and how many texts each set of rules (as bits) rejects."""
    seconds, rejected = dict.fromkeys(MEASURES, 0.0), Counter()
    for x in texts:
        t = Text(x)
        for name in MEASURES:  # each after those that it is made from
            began = time.perf_counter()
            getattr(t, name)
            seconds[name] += time.perf_counter() - began
        rejected[sum(1 << i for i, r in enumerate(rules) if r.rejects(t))] += 1
    return seconds, rejected


def in_order(rules: Sequence[Rule], seconds: dict[str, float], rejected: dict[int, int]) -> list[Rule]:
    """The rules by rejections per second of what they add; ties keep the given order."""
    left, known, out, texts = list(range(len(rules))), set(), [], dict(rejected)
    while left:

        def gain(i: int) -> float:
            hits = sum(n for mask, n in texts.items() if mask >> i & 1)
            return hits / (sum(seconds.get(m, 0.0) for m in rules[i].needs if m not in known) + 1e-9)

        best = max(left, key=lambda i: (gain(i), -i))
        left.remove(best)
        known |= set(rules[best].needs)
        texts = {mask: n for mask, n in texts.items() if not mask >> best & 1}
        out.append(rules[best])
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *FURTHER), sample_rows: int = 1000) -> list[Rule]:
    """The rules in the order of their gain on about sample_rows documents (twice as many at most); without any, in the given order."""

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seconds, rejected = trial(b.column(0).to_pylist(), rules)
            rows = [(name, None, s, 0) for name, s in seconds.items()] + [(None, mask, 0.0, n) for mask, n in rejected.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.int64()))], ["measure", "mask", "seconds", "n"])

    sample = bounded_sample(docs.select("text"), sample_rows)
    rows = sample.mapInArrow(tried, "measure string, mask long, seconds double, n long").groupBy("measure", "mask").agg(F.sum("seconds").alias("s"), F.sum("n").alias("n")).collect()
    return in_order(rules, {r["measure"]: r["s"] for r in rows if r["measure"]}, {r["mask"]: r["n"] for r in rows if r["mask"] is not None})


def verdict(text: Text, rules: Sequence[Rule]) -> str | None:
    """The first rule that rejects the text, or None."""
    return next((r.name for r in rules if r.rejects(text)), None)


OUT = "doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame, rules: Sequence[Rule] = FURTHER, sample_rows: int = 1000) -> DataFrame:
    """One row per row of (doc_id, text): the five base measures, base_failed, kept and rejected_by.

    A null text has no words, so it fails the base rules like an empty one. Rows are judged one by one: ties,
    repeated ids and repeated texts change nothing, further columns are not read, and no rows give no rows.
    rejected_by names the rule that ended the document's cascade, or null; with several that would reject it depends on
    the order. The base measures are returned for every document, so they are made after the verdict if it did without.
    """
    ordered = cascade(docs, [*BASE, *rules], sample_rows)
    kind = docs.schema["doc_id"].dataType

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in COUNTS]
            by: list[str | None] = []
            base: list[bool] = []
            for x in b.column(1):
                t = Text(x.as_py())
                by.append(verdict(t, ordered))
                for to, name in zip(counts, COUNTS, strict=True):
                    to.append(getattr(t, name))
                base.append(verdict(t, BASE) is not None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.bool_()), pa.array([x is None for x in by]), pa.array(by, pa.string())],
                ["doc_id", *COUNTS, "base_failed", "kept", "rejected_by"],
            )

    return docs.select("doc_id", "text").mapInArrow(judged, OUT.format(id=kind.simpleString()))
