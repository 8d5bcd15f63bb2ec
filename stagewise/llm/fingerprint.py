"""SimHash fingerprints, their likeness, and search by permuted block tables.

Every term (a run of words) is hashed to BITS bits; each occurrence votes for its one bits and against its
zero bits, so a term's weight is its count. The signs of the sums are the fingerprint. The share of equal bits of two fingerprints estimates how alike their texts are.

Two fingerprints within a Hamming radius r differ by at most flips[i] bits in some block i of `blocks` bit blocks,
if the flips add up to r - blocks + 1: else they would differ by r + 1 bits at least. Fingerprints are entered under
the bits of each block, and a query asks for all values of a block that are so many flips from its own; so every pair
meets, and the keys stay as long as a block. The radius comes from a similarity of texts (radius_for).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ranges, stash, tasks, text_of
from .wordhash import mix, pieces, shingles, word_hashes

BITS = 128
#: Near copies are texts whose terms' counts have this cosine or more, such as texts of 100 words of which one is
#: replaced; a pair with just this cosine is within RADIUS with a probability of FOUND at least.
COSINE, FOUND = 0.98, 0.98
#: Texts of more terms than this are voted on in parts.
PART = 1 << 16


def simhash(texts: pa.Array, term_words: int = 2) -> np.ndarray:
    """BITS / 8 bytes for each text; all zero for one without words."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for i, part in pieces(texts):
        terms, at = shingles(word_hashes(part), term_words)
        votes = np.zeros((len(part), BITS), np.int64)
        for lo in range(0, len(terms), PART):
            h = terms[lo : lo + PART]
            raw = np.stack([mix(h + np.uint64(lane * 0x632BE59BD9B4E019 & (2**64 - 1))) for lane in range(1, BITS // 64 + 1)], axis=1)
            bits = np.unpackbits(raw.astype("<u8").view(np.uint8).reshape(len(h), BITS // 8), axis=1)
            owner = np.searchsorted(at, np.arange(lo, lo + len(h)), "right") - 1
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            size = np.diff(np.append(first, len(h)))
            votes[owner[first]] += 2 * ones - size[:, None]
        out[i : i + len(part)] = np.packbits(votes > 0, axis=1)
    return out


def hexes(prints: np.ndarray) -> list[str]:
    return [bytes(p).hex() for p in prints]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits, row by row."""
    return 1.0 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def fingerprints(docs: DataFrame, term_words: int = 2) -> DataFrame:
    """(doc_id, fingerprint) for every row of (doc_id, text); a null text is empty, equal texts get equal fingerprints."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def stamped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hexes(simhash(b.column(1), term_words)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(stamped, f"doc_id {kind}, fingerprint string")


def radius_for(cosine: float = COSINE, found: float = FOUND) -> int:
    """The least radius in which texts of this cosine fall with a probability of `found`: each bit differs with that of their angle over pi."""
    p, total = math.acos(cosine) / math.pi, 0.0
    for r in range(BITS):
        total += math.comb(BITS, r) * p**r * (1 - p) ** (BITS - r)
        if total >= found:
            return r
    return BITS


RADIUS = radius_for()
#: With so many blocks, no block of two fingerprints in RADIUS has to be asked for more than two flips away.
BLOCKS = 5


def layout(radius: int, blocks: int) -> list[tuple[int, int, int]]:
    """(start, size, flips) of the blocks that are searched; a radius below blocks - 1 needs only radius + 1 of them."""
    cut = [round(i * BITS / blocks) for i in range(blocks + 1)]
    more, longer = divmod(radius - blocks + 1, blocks)
    flips = [more + (i < longer) for i in range(blocks)]
    return [(a, b - a, n) for a, b, n in zip(cut, cut[1:], flips, strict=False) if n >= 0]


def block(fingerprint: Column, start: int, size: int) -> Column:
    """Bits start to start + size of a fingerprint, as a number; size is 32 at most."""
    i = min(start // 32, BITS // 32 - 2)
    high, low = (F.conv(F.substring(fingerprint, 8 * k + 1, 8), 16, 10).cast("long") for k in (i, i + 1))
    both = F.shiftleft(high, 32).bitwiseOR(low)
    return F.shiftrightunsigned(both, 64 - (start - 32 * i) - size).bitwiseAND(F.lit((1 << size) - 1).cast("long"))


def flipped(size: int, flips: int) -> list[int]:
    """All numbers of `size` bits of which at most `flips` are set."""
    return [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(size), n)]


def keys(fingerprint: Column, blocks: list[tuple[int, int, int]], asked: bool) -> Column:
    """Keys under which a fingerprint is entered, one for each block, or asked for: the block's number above its bits."""

    def of_block(i: int, start: int, size: int, flips: int) -> Column:
        own = block(fingerprint, start, size).bitwiseOR(F.lit(i << 40).cast("long"))
        masks = flipped(size, flips) if asked else [0]
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda mask: own.bitwiseXOR(mask))

    return F.concat(*[of_block(i, *b) for i, b in enumerate(blocks)])


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    total = None
    for i in range(0, BITS // 4, 8):
        word = [F.conv(F.substring(x, i + 1, 8), 16, 10).cast("long") for x in (a, b)]
        n = F.bit_count(word[0].bitwiseXOR(word[1]))
        total = n if total is None else total + n
    return total


def within(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All (query, fingerprint, distance) with distance <= radius, between the distinct fingerprints of both sides.

    Rows that share a fingerprint are one entry of the tables, so copies cost nothing. Null fingerprints match nothing.
    """
    q = queries.select(F.col("fingerprint").alias("query")).dropna().distinct().repartition(tasks(queries.sparkSession))  # few, but each asks for many keys
    p = prints.select("fingerprint").dropna().distinct()
    searched = layout(radius, blocks)
    left = q.select("query", F.explode(keys(F.col("query"), searched, True)).alias("asked"))
    right = p.select("fingerprint", F.explode(keys(F.col("fingerprint"), searched, False)).alias("entered"))
    near = distance(F.col("query"), F.col("fingerprint"))
    first = None  # the first block in which a pair meets is the one that gives it
    for i, (start, size, flips) in reversed(list(enumerate(searched))):
        meets = F.bit_count(block(F.col("query"), start, size).bitwiseXOR(block(F.col("fingerprint"), start, size))) <= flips
        first = F.when(meets, i) if first is None else F.when(meets, i).otherwise(first)
    on = (F.col("asked") == F.col("entered")) & (near <= radius) & (F.shiftright("asked", 40) == first)
    return left.hint("merge").join(right, on).select("query", "fingerprint", near.alias("distance"))


def with_edits(docs: DataFrame, term_words: int = 2) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document's, by descending doc_id, then by text, null first; after the last comes the first.
    One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text is empty, null ids come last, a single row is its own next, no rows give no rows.

    Rows are dealt out by ranges of doc_id in one shuffle and read in order; each range also gets the first
    row of the range after it.
    """
    slim = docs.select("doc_id", text_of("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = ranges(docs, "doc_id")
    placed = slim.select("*", cut.number(F.col("doc_id")).alias("range"), cut.also(F.col("doc_id")).alias("before"))
    own = F.struct(F.col("range").alias("at"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("before").alias("at"), F.lit(1).alias("guest"))
    dealt = placed.select("doc_id", "text", F.explode(F.when(F.col("before").isNotNull(), F.array(own, guest)).otherwise(F.array(own))).alias("to")).select("to.at", "to.guest", "doc_id", "text")
    ordered = dealt.repartitionById(cut.n, F.col("at")).sortWithinPartitions("at", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def stamped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of the last row: at, guest, id, text

        def edited(rows: list[tuple]) -> pa.RecordBatch | None:
            """Rows in order, of which the last only serves as a next one."""
            ids, texts, nexts, new = [], [], [], []
            for (at, is_guest, key, text), (at2, _, _, text2) in zip(rows, rows[1:], strict=False):
                if not is_guest and at == at2:
                    ids.append(key)
                    texts.append(text)
                    nexts.append(text2)
                    half = len(text) // 2
                    new.append(text[: len(text) - half] + text2[:half])
            if not ids:
                return None
            a, b, c = (simhash(pa.array(x, pa.large_string()), term_words) for x in (texts, new, nexts))
            columns = [
                pa.array(ids, out_id),
                pa.array([len(x) for x in texts], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()),
                pa.array(hexes(a), pa.string()),
                pa.array(hexes(b), pa.string()),
                pa.array(likeness(a, b), pa.float64()),
                pa.array(likeness(a, c), pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        out_id = None
        for b in batches:
            out_id = b.schema.field("doc_id").type
            for lo in range(0, b.num_rows, 512):
                rows = list(zip(*(c.to_pylist() for c in b.slice(lo, 512).columns), strict=True))
                if out := edited(held + rows):
                    yield out
                held = rows[-1:]

    out = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(stamped, out)


def search(docs: DataFrame, every: int = 100, radius: int = 3, blocks: int = 6, term_words: int = 2) -> DataFrame:
    """with_edits(), first_id, n_within and partners.

    first_id: the least doc_id of the rows with this fingerprint, null if none of them has an id. For ids divisible by
    `every`, and null for others: n_within, the number of other rows within the radius of the fingerprint; partners, the
    first_id of every distinct fingerprint within the radius, its own too, in order. The rows within the radius are those
    whose first_id is one of the partners, and rows without an id.
    """
    df = stash(with_edits(docs, term_words), "prints")
    is_query = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    found = within(df.where(is_query), df, radius, blocks)
    held = df.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("held"), F.min("doc_id").alias("first_id"))
    links = found.join(held, "fingerprint").groupBy("query").agg((F.sum("held") - 1).alias("n_within"), F.array_sort(F.collect_list("first_id")).alias("partners"))
    notes = held.join(links, F.col("fingerprint") == F.col("query"), "left").where((F.col("held") > 1) | F.col("query").isNotNull())
    out = df.join(notes.select(F.col("fingerprint").alias("noted"), "first_id", "n_within", "partners"), F.col("fingerprint") == F.col("noted"), "left")
    return out.select(*df.columns, F.coalesce("first_id", "doc_id").alias("first_id"), *(F.when(is_query, F.col(c)).alias(c) for c in ("n_within", "partners")))
