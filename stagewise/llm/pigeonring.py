"""Near-duplicates by SimHash fingerprints of 64 bits whose neighbours are found by the pigeonring principle.

Segments of a fingerprint stand in a ring. If two fingerprints differ in `radius` bits at most, then a chain of segments
begins somewhere in the ring of which the first l segments together differ in l * radius / segments bits at most, for every
l up to the whole ring: a stricter test than that one segment alone differs in few bits. The budgets of the
first segments round down to no bit at all, so those are the key under which a fingerprint is entered, once for each place
of the ring; the following ones prune whom it meets there, before all bits are compared.

Keys with more than SMALL fingerprints are not paired. Two fingerprints differ in two bits at most exactly if a third
number lies within one bit of both. So each fingerprint of such a key names the numbers around it, 64 and its own, and those that
name the same one are links of the smallest among them: no more than 65 meet there, whatever a group's size. For a
radius above two, numbers within half of it are named.
Only distinct fingerprints are compared, and copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stash

BITS = 64
#: A term is hashed with XXH64 and this seed.
SEED = 42
RADIUS, SEGMENTS = 2, 5
#: Fingerprints under one key of which all are compared.
SMALL = 256
#: Shingles that are voted on at a time.
PART = 1 << 15


def simhash(text: str, words: int = 3) -> int:
    """The fingerprint of a text as an unsigned number: each bit is that of more than half of its shingles' hashes."""
    said = text.encode().lower().split()  # bytes: A-Z and the six ASCII blanks alone
    if not said:
        return 0
    k = min(words, len(said))
    runs = zip(*(said[i:] for i in range(k)), strict=False)
    hashed = np.array([xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in runs], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashed), PART):
        part = hashed[lo : lo + PART]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashed)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, print) for every row of (doc_id, text): 64 bits as a signed number. A null text has no words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def stamped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([simhash(t.as_py() or "", words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(stamped, f"doc_id {kind}, print long")


def masks(segments: int) -> list[int]:
    """The bits of each segment, as equal in number as can be."""
    cut = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def chain_masks(segments: int, length: int) -> list[int]:
    """For each place of the ring, the bits of the chain of so many segments that begins there."""
    parts = masks(segments)
    return [sum(parts[(i + j) % segments] for j in range(length)) for i in range(segments)]


def budget(length: int, radius: int, segments: int) -> int:
    """The most bits in which a chain of so many segments may differ."""
    return length * radius // segments


def entries(prints: DataFrame, radius: int, segments: int) -> DataFrame:
    """(print, place, key) for each distinct fingerprint and place of the ring: the bits of the chain that must be equal."""
    lead = max(n for n in range(1, segments + 1) if budget(n, radius, segments) == 0)
    held = F.array(*(F.lit(signed(m)).cast("long") for m in chain_masks(segments, lead)))
    return prints.select("print", F.posexplode(held).alias("place", "mask")).select("print", "place", F.col("print").bitwiseAND(F.col("mask")).alias("key"))


def in_budget(differing: Column, place: Column, radius: int, segments: int) -> Column:
    """Whether every longer chain from that place of the ring keeps its budget; the last chain is the whole fingerprint."""
    out = F.lit(True)
    for n in range(1, segments + 1):
        if 0 < budget(n, radius, segments) < budget(n + 1, radius, segments) or n == segments:  # the longest of equal budgets is the strictest
            held = F.array(*(F.lit(signed(m)).cast("long") for m in chain_masks(segments, n)))
            out = out & (F.bit_count(differing.bitwiseAND(F.element_at(held, place + 1))) <= budget(n, radius, segments))
    return out


def around(radius: int) -> Column:
    """Masks of all numbers of `radius` bits at most."""
    return F.array(*(F.lit(signed(sum(1 << i for i in c))).cast("long") for n in range(radius + 1) for c in combinations(range(BITS), n)))


def links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, small: int = SMALL) -> DataFrame:
    """(u, v), u > v, between distinct fingerprints (print) that differ in `radius` bits at most.

    Under keys of up to `small` fingerprints these are all such pairs. Of those that meet around a number under fuller keys,
    each is linked to the smallest: so every pair within the radius is connected by links, and no link is longer than the radius.
    An odd radius has no halves, and then no key is too full.
    """
    if not 0 < radius < segments <= BITS:
        raise ValueError("some segment must be without a budget: 0 < radius < segments")
    all_entries = stash(entries(prints, radius, segments), "ring")
    fill = all_entries.groupBy("place", "key").agg(F.count(F.lit(1)).alias("fill")).where("fill > 1")
    met = stash(all_entries.join(fill, ["place", "key"]), "met")
    few = met if radius % 2 else met.where(F.col("fill") <= small)
    a, b = few.select("place", "key", F.col("print").alias("u")), few.select("place", "key", F.col("print").alias("v"))
    near = in_budget(F.col("u").bitwiseXOR(F.col("v")), F.col("place"), radius, segments)
    found = a.join(b, ["place", "key"]).where((F.col("u") > F.col("v")) & near).select("u", "v")
    if radius % 2:
        return found.distinct()
    crowd = met.where(F.col("fill") > small).select("print").distinct()
    named = crowd.select("print", F.explode(around(radius // 2)).alias("mask")).select("print", F.col("print").bitwiseXOR(F.col("mask")).alias("point"))
    least = named.groupBy("point").agg(F.min("print").alias("v"), F.count(F.lit(1)).alias("fill")).where("fill > 1")
    hung = named.join(least, "point").where(F.col("print") > F.col("v")).select(F.col("print").alias("u"), "v")
    return found.unionByName(hung).distinct()


def near_classes(docs: DataFrame, words: int = 3, radius: int = RADIUS, segments: int = SEGMENTS, small: int = SMALL) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of (doc_id, text).

    component_id: the least doc_id that can be reached by links between fingerprints, the row's own included. Texts without
    words, null ones too, have the fingerprint zero and are linked like any other. Rows of one id, and rows without one, all
    stay; a component none of whose rows has an id has none. Words of any length and texts of any number of words count whole.
    No documents give no rows.
    """
    df = stash(fingerprints(docs, words), "prints")
    held = stash(df.groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = components(links(held.select("print"), radius, segments, small))
    least = held.join(found, F.col("print") == F.col("id")).groupBy("component").agg(F.min("first_id").alias("least_id"))
    linked = found.join(least, "component").select(F.col("id").alias("print"), "least_id")
    notes = held.join(linked, "print", "left").select(F.col("print").alias("noted"), F.coalesce("least_id", "first_id").alias("component_id"))
    out = df.join(notes, F.col("print") == F.col("noted"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
