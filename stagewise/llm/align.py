"""Alignment of two tokenizers' ids by the places in a text at which tokens of both end.

Tokenizer A is a byte-level BPE in a file of the tokenizers library and reads a space before the text; B is a
sentencepiece model, which adds that space itself. Where a token of A and one of B end at the same byte, both are linked, and
what lies between two such places is a group. How often two ids are linked, in the whole corpus, tells which id of A stands for an id of B.

1. Texts are encoded once and their links written: (row, distinct pairs of ids, how often). A text is cut before single
   spaces, where neither tokenizer can join anything, and a piece that was met before is not encoded again.
2. Id-striped counting: an id b of B belongs to the stripe b % stripes, so that frequent ids, which are neighbours, are spread
   over stripes. Tasks add up pairs before they are sent; a stripe is a dense matrix of its ids of B by all of A, whose
   size follows from the vocabularies alone. np.add.at fills it, and the maxima of its rows are the best links.
3. Links are dealt out by stripe too, and counts go where their stripe's links are. A stripe with more than its share of links,
   such as that of an id that a third of all links hold, is dealt over several tasks, each of which gets its counts. Every
   task fills one stripe's matrix at a time and reads the links past it; what it finds is added up by row.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import missing, parted
from .shared import stash, tasks

#: A space that stands alone between two other characters: no token of either kind reaches over its beginning.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: A space before one of these, or at an end of a text, does not stand so.
NOT_ALONE = [f" {c}" for c in map(chr, range(1 << 16)) if c.isspace()]
#: Ids of B in a stripe's matrix. With 50,000 ids of A it takes 13 MB.
WIDTH = 32
#: Characters of pieces whose tokens a worker remembers, and pairs that a task adds up, or deals out, at a time.
REMEMBERED, ADDED_UP = 1 << 22, 1 << 20
#: Pieces that are encoded as one text.
TOGETHER = 64
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the rest from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Slice(NamedTuple):
    """What the two tokenizers make of some texts: by text tokens of each, its groups as text, or null where it has no tokens; and the links of all, text by text."""

    n_a: list[int]
    n_b: list[int]
    groups: list[bytes | None]
    n_links: np.ndarray
    a: np.ndarray
    b: np.ndarray


class Aligner:
    """Both tokenizers, and what they made of the pieces that were met: n_a, n_b and groups by piece, and the links of piece i at starts[i]:starts[i + 1]."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.first = Tokenizer.from_file(byte_file)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        alphabet = byte_alphabet()
        self.size_a, self.size_b = self.first.get_vocab_size(), self.second.get_piece_size()
        entries = [self.first.id_to_token(i) or "" for i in range(self.size_a)]
        self.a_bytes = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
        pieces = [self.second.id_to_piece(i) for i in range(self.size_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode() for p in pieces]
        self.length_a, self.length_b = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        #: an id of A with what follows it inside its group and at the end of its side, then the same of B
        self.written = [b"%d%s" % (i, end) for n, ends in ((self.size_a, (b",", b"|")), (self.size_b, (b",", b";"))) for end in ends for i in range(n)]
        self.length_written = np.array([len(x) for x in self.written], np.int64)
        self.cuts = self.can_cut(pieces)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.n_a, self.n_b, self.bad = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.groups: list[bytes | None] = []
        self.starts, self.a, self.b = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def can_cut(self, pieces: list[str]) -> bool:
        """Whether texts may be cut: A splits before a space followed by a word, and no piece of B holds a space after another character."""
        trial = "a b  c d'll 7 -x"
        keeps = "".join(self.second.encode(" a  b ", out_type=str)) == f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}"
        splits = self.first.normalizer is None and self.first.pre_tokenizer is not None
        words = [w for w, _ in self.first.pre_tokenizer.pre_tokenize_str(trial)] if splits else []
        byte_level = words == ["a", "Ġb", "Ġ", "Ġc", "Ġd", "'ll", "Ġ7", "Ġ-", "x"]
        return keeps and byte_level and not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def learn(self, new: list[str], together: int) -> None:
        """Encode pieces, each after a space and so many in a text, and remember what came of them. Several stand in a text only
        if it would be cut between them; those of a text that a tokenizer does not give back are encoded again one by one."""
        if not new:
            return
        texts = new if together == 1 else [" ".join(new[i : i + together]) for i in range(0, len(new), together)]
        both_a = [x.ids for x in self.first.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        both_b = self.second.encode(texts, num_threads=1)
        (a, at_a), (b, at_b) = (flat(lists) for lists in (both_a, both_b))
        bad = np.zeros(len(texts), bool)
        said = f" {' '.join(texts)}".encode()
        if any(b"".join(map(names.__getitem__, ids.tolist())) != said for names, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            for i, (x, y, t) in enumerate(zip(both_a, both_b, texts, strict=True)):
                bad[i] = any(b"".join([names[k] for k in ids]) != f" {t}".encode() for names, ids in ((self.a_bytes, x), (self.b_bytes, y)))
            if together > 1:
                for wrong, count in ((False, together), (True, 1)):
                    self.learn([p for i in np.flatnonzero(bad == wrong).tolist() for p in new[i * together : (i + 1) * together]], count)
                return
            (a, at_a), (b, at_b) = (flat([[] if no else x for x, no in zip(lists, bad.tolist(), strict=True)]) for lists in (both_a, both_b))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        if together > 1:
            bad = np.zeros(len(new), bool)
            ends = np.cumsum(np.array([len(p.encode()) for p in new], np.int64) + 1)
            at_a, at_b = (np.concatenate([[0], np.searchsorted(x, ends) + 1]) for x in (ends_a, ends_b))
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        # groups follow one another, in each A's tokens before B's
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a] = end_b[last_b] = 1
        before_b, upto_a = np.concatenate([[0], last_b + 1]), np.append(last_a + 1, 0)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b[np.cumsum(end_a) - end_a]] = a + self.size_a * end_a
        order[np.arange(len(b)) + upto_a[np.cumsum(end_b) - end_b]] = b + 2 * self.size_a + self.size_b * end_b
        upto = np.concatenate([[0], np.cumsum(self.length_written[order])])[at_a + at_b]
        groups = parted(b"".join(map(self.written.__getitem__, order.tolist())), np.diff(upto))
        for i in np.flatnonzero(bad).tolist():
            groups[i] = None
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.groups += groups
        self.n_a, self.n_b, self.bad = np.append(self.n_a, np.diff(at_a)), np.append(self.n_b, np.diff(at_b)), np.append(self.bad, bad)
        self.chars += sum(map(len, new))
        self.starts = np.append(self.starts, self.starts[-1] + np.searchsorted(last_a, at_a[1:]))
        self.a, self.b = np.append(self.a, a[last_a].astype(np.int32)), np.append(self.b, b[last_b].astype(np.int32))

    def pieces(self, text: str) -> list[str]:
        """The text cut at spaces that stand alone; if all do, without looking at each."""
        if not self.cuts:
            return [text]
        alone = not (text.startswith(" ") or text.endswith(" ") or any(x in text for x in NOT_ALONE))
        return text.split(" ") if alone else CUT.split(text)

    def texts(self, texts: list[str]) -> Slice:
        cut = list(map(self.pieces, texts))
        if self.chars > REMEMBERED:
            self.forget()
        parts = list(chain.from_iterable(cut))
        numbers = list(map(self.number.get, parts))
        gaps = list(missing(numbers))
        new = list(dict.fromkeys([parts[i] for i in gaps]))
        plain = [p for p in new if p and p[-1] != " " and not p[0].isspace()] if self.cuts else []
        for pieces, together in ((plain, TOGETHER), (list(set(new).difference(plain)), 1)):
            for lo in range(0, len(pieces), 1 << 15):
                self.learn(pieces[lo : lo + (1 << 15)], together)
        for i in gaps:
            numbers[i] = self.number[parts[i]]
        k, sizes = np.array(numbers, np.int64), np.array([len(x) for x in cut], np.int64)
        ends = np.cumsum(sizes)
        of, at = np.repeat(np.arange(len(texts)), sizes), [0, *ends.tolist()]
        void = np.array([not t for t in texts], bool)
        void[of[self.bad[k]]] = True
        groups = [None if no else b"".join(map(self.groups.__getitem__, numbers[i:j]))[:-1] for no, i, j in zip(void.tolist(), at, at[1:], strict=False)]
        kept = ~void[of]
        k, of = k[kept], of[kept]
        first, n = self.starts[k], self.starts[k + 1] - self.starts[k]
        take = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        n_a, n_b, n_links = (added(x, of, len(texts)) for x in (self.n_a[k], self.n_b[k], n))
        return Slice(n_a.tolist(), n_b.tolist(), groups, n_links, self.a[take].astype(np.int64), self.b[take].astype(np.int64))


def added(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The sum of each text's values, which stand together, text by text."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return np.diff(upto[np.searchsorted(of, np.arange(n + 1))])


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a row, and where each list's begin."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    return np.fromiter(chain.from_iterable(lists), np.int64, int(starts[-1])), starts


@lru_cache(maxsize=1)
def aligner(byte_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_file, piece_file)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, none below zero, in as few bytes each as the largest needs; unpacked() is told how many there are."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


LINKED = "row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs long, a binary, b binary, times binary"


def linked(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """A row for each row of (doc_id, text), numbered: counts, the digest of its groups, and its distinct pairs of linked ids with how often each is."""
    schema = LINKED.format(kind=docs.schema["doc_id"].dataType.simpleString())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_file, piece_file)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                found = both.texts([t or "" for t in b.column(2).to_pylist()])
                keys, times = added_up(np.repeat(np.arange(b.num_rows), found.n_links) << 40 | found.b * both.size_a + found.a, np.ones(len(found.a), np.int64))
                at = np.searchsorted(keys >> 40, np.arange(b.num_rows + 1)).tolist()
                pairs = keys & (1 << 40) - 1
                columns = [[packed(x[i:j]) for i, j in zip(at, at[1:], strict=False)] for x in (pairs % both.size_a, pairs // both.size_a, times)]
                digests = ["" if g is None else hashlib.sha256(g).hexdigest() for g in found.groups]
                counts = (found.n_a, found.n_b, found.n_links, found.n_links, digests, np.diff(at), *columns)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, counts)], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(encoded, schema)


class Stripes(NamedTuple):
    """How many stripes, their matrices' columns, and ids of B in each."""

    n: int
    n_a: int
    width: int


def stripes_of(byte_file: str, piece_file: str, width: int) -> Stripes:
    both = aligner(byte_file, piece_file)
    n = -(-both.size_b // width)
    return Stripes(n, both.size_a, -(-both.size_b // n))


def by_stripe(a: np.ndarray, b: np.ndarray, s: Stripes) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Each stripe that holds some of the pairs: (stripe, where its pairs are in the order, the order)."""
    order = np.argsort(b % s.n, kind="stable")
    of = (b % s.n)[order]
    at = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(of)]
    for lo, hi in zip(at, at[1:], strict=False):
        yield int(of[lo]), slice(lo, hi), order


COUNTED = "stripe int, pairs long, a binary, b binary, times binary"


def pair_counts(links: DataFrame, s: Stripes) -> DataFrame:
    """(stripe, pairs, a, b, times) a row for each stripe: the pairs of ids that are linked anywhere, and how often."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = [], []

        def sent() -> pa.RecordBatch:
            k, t = added_up(np.concatenate(keys), np.concatenate(times))
            a, b = k % s.n_a, k // s.n_a
            rows = [(of, x.stop - x.start, packed(a[o[x]]), packed(b[o[x]]), packed(t[o[x]])) for of, x, o in by_stripe(a, b, s)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        held = 0
        for batch in batches:
            for n, a, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n:
                    keys.append(unpacked(b, n) * s.n_a + unpacked(a, n))
                    times.append(unpacked(t, n))
                    held += n
                if held > ADDED_UP:
                    k, v = added_up(np.concatenate(keys), np.concatenate(times))
                    keys, times, held = [k], [v], len(k)
                    if held > ADDED_UP // 2:
                        yield sent()
                        keys, times, held = [], [], 0
        if held:
            yield sent()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = np.zeros((s.width, s.n_a), np.int64), None

        def full() -> pa.RecordBatch:
            row, a = np.nonzero(block)
            values = (now, len(a), packed(a), packed(row * s.n + now), packed(block[row, a]))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for of, n, a, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != now:
                    if now is not None:
                        yield full()
                        block[:] = 0
                    now = of
                np.add.at(block, (unpacked(b, n) // s.n, unpacked(a, n)), unpacked(t, n))
        if now is not None:
            yield full()

    names, kinds = [x.split()[0] for x in COUNTED.split(", ")], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    parts = links.where("pairs > 0").select("pairs", "a", "b", "times").mapInArrow(partial, COUNTED)
    return parts.repartition(tasks(links.sparkSession), "stripe").sortWithinPartitions("stripe").mapInArrow(summed, COUNTED)


def dealt(weights: dict[int, int], n: int) -> dict[int, list[int]]:
    """The tasks, of n, that each stripe's links go to: heavy stripes to several, so that no task gets much more than its share. Bounded by stripes and tasks."""
    share = max(1, -(-sum(weights.values()) // n))
    heap = [(0, i) for i in range(n)]
    out: dict[int, list[int]] = {}
    for stripe, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        parts = min(n, -(-weight // share))
        taken = [heapq.heappop(heap) for _ in range(parts)]
        for load, i in taken:
            heapq.heappush(heap, (load + weight // parts, i))
        out[stripe] = [i for _, i in taken]
    return out


def scored(links: DataFrame, counts: DataFrame, s: Stripes) -> DataFrame:
    """(row, n_best, count_sum) parts of each row's sums, one for each task and stripe that holds links of the row."""
    spark = links.sparkSession
    heavy = counts.select("stripe", F.col("pairs"), "times").mapInArrow(totals, "stripe int, links long")
    places = dealt({r["stripe"]: r["links"] for r in heavy.collect()}, tasks(spark))  # a row a stripe
    shared = spark.sparkContext.broadcast(places)

    def striped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            held = np.cumsum(batch.column(1).to_numpy())
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + ADDED_UP, "right")))
                rows, ns, *raw = (c.to_pylist() for c in batch.slice(at, end - at).columns)
                at = end
                a, b, t = (np.concatenate([unpacked(x, n) for x, n in zip(column, ns, strict=True)]) for column in raw)
                base, out = min(rows), []
                of_row = np.repeat(np.array(rows, np.int64) - base, ns)
                for of, x, o in by_stripe(a, b, s):
                    pick, to = o[x], shared.value[of]
                    out.append((to[turn % len(to)], of, 1, len(pick), base, packed(of_row[pick]), packed(a[pick]), packed(b[pick] // s.n), packed(t[pick])))
                    turn += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, of, 0, n, 0, b"", a, packed(unpacked(b, n) // s.n), t) for of, n, a, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i in shared.value[of]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = np.zeros((s.width, s.n_a), np.int64), np.zeros(s.width, np.int64)
        for batch in batches:
            for _, _, is_link, n, base, rows, a, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b, t = unpacked(a, n), unpacked(b, n), unpacked(t, n)
                if not is_link:  # a stripe's counts come before its links
                    block[:] = 0
                    np.add.at(block, (b, a), t)
                    best = block.max(axis=1)
                    continue
                rows, count = unpacked(rows, n), block[b, a]
                first = np.flatnonzero(np.diff(rows, prepend=-1))  # in order, since by_stripe keeps it
                sums = [np.add.reduceat(x, first) for x in (np.where(count == best[b], t, 0), count * t)]
                yield pa.RecordBatch.from_arrays([pa.array(base + rows[first]), *map(pa.array, sums)], ["row", "n_best", "count_sum"])

    layout = "task int, stripe int, is_link int, n long, base long, rows binary, a binary, b binary, times binary"
    names, kinds = [x.split()[0] for x in layout.split(", ")], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    asked = links.where("pairs > 0").select("row", "pairs", "a", "b", "times").mapInArrow(striped, layout)
    told = counts.select("stripe", "pairs", "a", "b", "times").mapInArrow(known, layout)
    placed = asked.unionByName(told).repartitionById(tasks(spark), F.col("task")).sortWithinPartitions("stripe", "is_link")
    return placed.mapInArrow(looked_up, "row long, n_best long, count_sum long")


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, ns, times = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([int(unpacked(t, n).sum()) for t, n in zip(times, ns, strict=True)], pa.int64())], ["stripe", "links"])


def alignment(docs: DataFrame, byte_file: str, piece_file: str, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of (doc_id, text).

    n_best counts links whose count is the highest that their id of B has, ties included; count_sum adds up all links'
    counts. Null and empty texts, and those that either tokenizer does not give back byte for byte, have no tokens: zeros
    and an empty digest. Rows of one id, or of none, are counted each for itself. A text of any length is one row's work;
    copies count as often as they are there. No documents give no rows.
    """
    s = stripes_of(byte_file, piece_file, width)
    df = stash(linked(docs, byte_file, piece_file), "links")
    counts = stash(pair_counts(df, s), "counts")
    parts = scored(df, counts, s).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = df.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(parts, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def best_links(docs: DataFrame, byte_file: str, piece_file: str, width: int = WIDTH) -> DataFrame:
    """(b, a, count): for every id of B that is linked anywhere, its ids of A with the highest count, ties included."""
    s = stripes_of(byte_file, piece_file, width)
    counts = pair_counts(stash(linked(docs, byte_file, piece_file), "links"), s)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, a, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b, t = unpacked(a, n), unpacked(b, n), unpacked(t, n)
                top = np.zeros(s.width, np.int64)
                np.maximum.at(top, b // s.n, t)
                keep = t == top[b // s.n]
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (b, a, t)], ["b", "a", "count"])

    return counts.select("pairs", "a", "b", "times").mapInArrow(best, "b long, a long, count long")
