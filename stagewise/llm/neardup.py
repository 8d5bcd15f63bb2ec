"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Document frequencies of shingles, over all documents. A shingle's weight is tf * (1 + its part of the largest idf),
   and depends on the share of documents that hold it alone; below SHARE all weigh the same. So only shingles above
   SHARE need a count: a table of CELLS hashed counts tells where they can be, and those there are counted exactly.
   There are fewer of them than shingles in 1 / SHARE documents, however many documents there are.
2. BANDS * ROWS samples are drawn from a document's weights so that two documents draw the same one with a
   probability of their weighted Jaccard similarity. Equal texts are one entry, by their MD5. Entries that agree
   on all samples of a band are candidates.
3. Candidates are verified by the weighted Jaccard similarity of their whole bags. In buckets of up to SMALL entries
   all are compared. In larger ones everyone is first compared to one leader (LEADER_ROUNDS of them), which differs from round to round and
   from bucket to bucket. Entries of buckets that stay in several components are then joined exactly: two entries
   at the threshold share one of the rarest shingles that make up a ninth of the lighter and of about so much of the
   heavier one (prefixes by the least overlap that their weights allow); those that do, in different components, are
   verified. So every pair of candidates is verified, connected or proven to be below the threshold, and the
   components are those of all pairs, without comparing all pairs of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import lean, stash, text_of
from .wordhash import mix, pieces, shingles, word_hashes

CELLS = 1 << 20
SLICES = 64
BANDS, ROWS = 16, 4
#: Bits of the table that spares documents without candidates a second reading; its size is fixed too.
FILTER_BITS = 1 << 23
LEVELS = 1 << 16
#: Shingles in a smaller share of the documents all weigh the same.
SHARE = 2.0**-10
SMALL = 6
LEADER_ROUNDS = 1
#: Classes of total weight, for prefixes, are so many times apart.
STEP = 1.02


class Bags(NamedTuple):
    """Distinct shingles of texts, one text after another: hashes, counts, and where each text begins."""

    hashes: np.ndarray
    counts: np.ndarray
    starts: np.ndarray


def bags(texts: pa.Array, words: int) -> Bags:
    terms, at = shingles(word_hashes(texts), words)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(at))
    keys, counts = np.unique((owner << np.uint64(32)) | (terms >> np.uint64(32)), return_counts=True)
    starts = np.searchsorted(keys >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
    return Bags((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts, starts)


def document_frequencies(docs: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """The number of documents and, for each cell, how many shingles of documents fall into it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(CELLS, np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, part in pieces(b.column(0)):
                cells += np.bincount(bags(part, words).hashes & np.uint32(CELLS - 1), minlength=CELLS)
        if n:
            z = zstandard.ZstdCompressor(level=1)
            blobs = [z.compress(x.astype("<i8").tobytes()) for x in np.split(cells, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array(blobs, pa.binary())], ["slice", "n", "blob"])

    def summed(table: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        total = np.zeros(CELLS // SLICES, np.int64)
        for x in table.column("blob"):
            total += np.frombuffer(z.decompress(x.as_py()), "<i8")
        return pa.table({"slice": table.column("slice")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "blob": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    kind = "slice int, n long, blob binary"
    rows = docs.select(text_of("text").alias("text")).mapInArrow(lean(counted), kind).groupBy("slice").applyInArrow(summed, kind).collect()
    table = np.zeros(CELLS, np.int64)
    for r in rows:
        table[r["slice"] * (CELLS // SLICES) : (r["slice"] + 1) * (CELLS // SLICES)] = np.frombuffer(r["blob"], "<i8")
    return (rows[0]["n"] if rows else 0), table


class Weights(NamedTuple):
    """Weights of shingles: `rare`, but for some, which are in the cells marked; 1 for one in all documents."""

    cells: np.ndarray
    hashes: np.ndarray
    values: np.ndarray
    rare: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rare, np.float32)
        at = np.flatnonzero(self.cells[hashes & np.uint32(CELLS - 1)]) if len(self.hashes) else ()
        if len(at):
            h = hashes[at]
            i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[i] == h
            out[at[known]] = self.values[i[known]]
        return out


def idf_weights(docs: DataFrame, words: int) -> Weights:
    """Weights from the exact counts of all shingles in more than SHARE of the documents."""
    n, table = document_frequencies(docs, words)
    least = max(1.0, SHARE * n)
    cells = table > least

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = marked.value
        for b in batches:
            for _, part in pieces(b.column(0)):
                h = bags(part, words).hashes
                keys, counts = np.unique(h[marks[h & np.uint32(CELLS - 1)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["shingle", "n"])

    marked = docs.sparkSession.sparkContext.broadcast(cells)
    found = docs.select(text_of("text").alias("text")).mapInArrow(lean(counted), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = found.where(F.col("n") > least).toPandas().sort_values("shingle") if cells.any() else None  # at most the shingles of 1 / SHARE documents
    kept = (often["shingle"].to_numpy().astype(np.uint32), often["n"].to_numpy().astype(np.float64)) if often is not None else (np.zeros(0, np.uint32), np.zeros(0))

    def weight(df):
        return 1 + np.log(max(n, 1) / df) / np.log(1 / SHARE)

    return Weights(cells, kept[0], weight(kept[1]).astype(np.float32), float(weight(least)) if n else 1.0)


def gamma_levels() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at LEVELS even steps, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(LEVELS) + 0.5) / LEVELS
    x = np.maximum(np.sqrt(2 * p), -np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
    return x


class Sampler:
    """Improved consistent weighted sampling: r and c from Gamma(2, 1), beta from [0, 1), by hashes of (shingle, sample)."""

    def __init__(self, weights: Weights) -> None:
        self.weights = weights
        levels = gamma_levels()
        self.r, self.log_c = levels.astype(np.float32), np.log(levels).astype(np.float32)

    def bands(self, bag: Bags) -> np.ndarray:
        """One hash for each text that has shingles and each band."""
        n = np.diff(bag.starts)
        full = np.flatnonzero(n)
        starts, sizes = bag.starts[:-1][full], n[full]
        log_w = np.log(bag.counts * self.weights.of(bag.hashes)).astype(np.float32)
        h = bag.hashes.astype(np.uint64)
        owner = np.repeat(np.arange(len(full)), sizes)
        out = np.zeros((len(full), BANDS), np.uint64)
        if not len(full):
            return out
        for k in range(BANDS * ROWS):
            z = mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            r = self.r[z & np.uint64(LEVELS - 1)]
            beta = (z >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            t = np.floor(log_w / r + beta)
            log_a = self.log_c[(z >> np.uint64(16)) & np.uint64(LEVELS - 1)] - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(log_a, starts)
            at = np.flatnonzero(log_a == np.repeat(least, sizes))
            at = at[np.flatnonzero(np.diff(owner[at], prepend=-1))]
            drawn = mix(h[at] ^ (t[at].astype(np.int64).astype(np.uint64) << np.uint64(32)))
            out[:, k // ROWS] = mix(out[:, k // ROWS] * np.uint64(31) + drawn)
        return out


def signatures(docs: DataFrame, words: int, weights) -> DataFrame:
    """(doc_id, h, bands) of every document: the MD5 of its text, and a hash for each band; none without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(weights.value)
        for b in batches:
            for i, part in pieces(b.column(2), 1 << 18):
                bag = bags(part, words)
                full = np.diff(bag.starts) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(full * BANDS)), pa.int32()), pa.array(sampler.bands(bag).astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), b.column(1).slice(i, len(part)), lists], ["doc_id", "h", "bands"])

    text = text_of("text")
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("h"), text.alias("text")).mapInArrow(lean(signed), f"doc_id {kind}, h binary, bands array<long>")


def filter_bits(ids: pa.Array) -> np.ndarray:
    return mix(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)) & np.uint64(FILTER_BITS - 1)


def filter_of(ids: DataFrame) -> np.ndarray:
    """A bit table in which the bits of all ids are set."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(FILTER_BITS, bool)
        for b in batches:
            table[filter_bits(b.column(0))] = True
        if table.any():
            parts = np.split(np.packbits(table), SLICES)
            used = [i for i, x in enumerate(parts) if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zstandard.compress(parts[i].tobytes(), 1) for i in used], pa.binary())], ["slice", "blob"])

    def merged(table: pa.Table) -> pa.Table:
        total = np.zeros(FILTER_BITS // 8 // SLICES, np.uint8)
        for x in table.column("blob"):
            total |= np.frombuffer(zstandard.decompress(x.as_py()), np.uint8)
        return pa.table({"slice": table.column("slice")[:1], "blob": pa.array([total.tobytes()], pa.binary())})

    kind = "slice int, blob binary"
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in ids.mapInArrow(marked, kind).groupBy("slice").applyInArrow(merged, kind).collect():
        size = len(r["blob"])
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["blob"], np.uint8)
    return out


def vectors(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(h, bag) of the wanted (h, id) texts: sorted shingle hashes, then their counts."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(wanted.select("id")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for b in batches:
            at = filter_bits(b.column(0))
            b = b.filter(pa.array((table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1))
            for i, part in pieces(b.column(2)) if b.num_rows else ():
                h, n, starts = bags(part, words)
                blobs = [h[x:y].astype("<u4").tobytes() + n[x:y].astype("<u4").tobytes() for x, y in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, len(part)), pa.array(blobs, pa.binary())], ["h", "bag"])

    text = text_of("text")
    found = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text)).alias("h"), text.alias("text")).mapInArrow(lean(packed), "h binary, bag binary")
    return found.join(wanted.select("h"), "h", "left_semi").dropDuplicates(["h"])


def unpacked(bag: bytes, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.split(np.frombuffer(bag, "<u4"), 2)
    return h, n * weights.of(h).astype(np.float64)


def weighted_jaccard(a: bytes, b: bytes, weights: Weights) -> float:
    (hx, wx), (hy, wy) = unpacked(a, weights), unpacked(b, weights)
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    both = float(np.minimum(wx[i], wy[j]).sum())
    return both / max(float(wx.sum() + wy.sum()) - both, 1e-12)


def verified(pairs: DataFrame, bag: DataFrame, weights, threshold: float) -> DataFrame:
    """(u, v, linked) of every pair (u, v)."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [weighted_jaccard(x.as_py(), y.as_py(), weights.value) >= threshold - 1e-9 for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["u", "v", "linked"])

    left, right = (bag.select(F.col("h").alias(x), F.col("bag").alias(f"{x}_bag")) for x in "uv")
    df = pairs.join(right, "v").join(left, "u")
    return df.select("u", "v", "u_bag", "v_bag").mapInArrow(lean(compared), "u binary, v binary, linked boolean")


def paired(x: str = "x", y: str = "y") -> list[Column]:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """(h, component) of all entries after more links (u, v): only the components that they join are worked on."""
    ends = [label.select(F.col("h").alias(x), F.col("component").alias(f"{x}_component")) for x in "uv"]
    between = links.join(ends[0], "u").join(ends[1], "v").where("u_component <> v_component").select(F.col("u_component").alias("u"), F.col("v_component").alias("v")).distinct()
    joined = components(between).select(F.col("id").alias("component"), F.col("component").alias("over"))
    return stash(label.join(joined, "component", "left").select("h", F.coalesce("over", "component").alias("component")), "components")


def led(large: DataFrame, label: DataFrame, k: int) -> DataFrame:
    """(u, v) of every entry of a large bucket and the bucket's leader in round k, if they are in different components.

    The first leader is the entry that meets most others in all its buckets, such as the text that the others are copies of.
    """
    placed = large.join(label, "h")
    first = -F.col("met") if k == 0 else F.lit(0)
    lead = placed.groupBy("bucket").agg(F.min(F.struct(first.alias("first"), F.xxhash64("h", F.lit(k)).alias("o"), F.col("h").alias("x"), "component")).alias("l")).select("bucket", "l.x", F.col("l.component").alias("lead"))
    return placed.join(lead, "bucket").where("component <> lead").select(*paired("x", "h")).distinct()


def prefix_pairs(large: DataFrame, label: DataFrame, bag: DataFrame, weights, threshold: float) -> DataFrame:
    """(u, v) of entries of several components that can be alike, of all buckets that hold several.

    Shingles are ordered by how many of these entries hold them. `rest` is what an entry weighs from a shingle on. Two
    entries overlap by least(rest) at most if this is the first that they share, and by t / (1 + t) of both weights
    at least if they are alike; the lighter is looked for by its class of weight, for which the heavier is cut.
    """
    placed = large.join(label, "h")
    split = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    apart = placed.join(split.select("bucket"), "bucket", "left_semi").select("h", "component").distinct()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c, x in zip(*(col.to_pylist() for col in b.columns), strict=True):
                terms, w = unpacked(x, weights.value)
                k = len(terms)
                yield pa.RecordBatch.from_arrays([pa.array([h] * k, pa.binary()), pa.array([c] * k, pa.binary()), pa.array(terms.astype(np.int64)), pa.array(w), pa.array(np.full(k, w.sum()))], ["h", "component", "shingle", "w", "total"])

    terms = stash(apart.join(bag, "h").select("h", "component", "bag").mapInArrow(listed, "h binary, component binary, shingle long, w double, total double"), "terms")
    held = terms.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    after = Window.partitionBy("h").orderBy(F.desc("n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)  # from the last shingle on: a running sum
    t, share = threshold, threshold / (1 + threshold) * (1 - 1e-9)
    ranked = terms.join(held, "shingle").withColumn("rest", F.sum("w").over(after)).where(F.col("rest") >= t * (1 - 1e-9) * F.col("total")).where("n > 1")
    ranked = ranked.select("h", "component", "shingle", "total", "rest", F.floor(F.log("total") / np.log(STEP)).cast("int").alias("own"))
    least = F.floor(F.log(F.col("total") * t) / np.log(STEP)).cast("int")
    asked = ranked.withColumn("class", F.explode(F.sequence(least, F.col("own"))))
    lightest = F.greatest(F.pow(F.lit(STEP), "class"), t * F.col("total"))
    asks = asked.where(F.col("rest") >= share * (lightest + F.col("total"))).withColumn("asks", F.lit(True)).drop("own")
    stands = ranked.where(F.col("rest") >= 2 * share * F.col("total")).withColumn("asks", F.lit(False)).withColumnRenamed("own", "class")
    rows = stash(stands.unionByName(asks), "prefixes")
    key = ["class", "shingle"]
    most = rows.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max_by("component", "n").alias("main"), F.count(F.lit(1)).alias("several")).where("several > 1")
    rows = rows.join(most.select(*key, "main"), key)
    lighter, heavier = (rows.where(c).select(*key, *(F.col(n).alias(f"{x}_{n}") for n in ("h", "component", "total", "rest")), (F.col("component") == F.col("main")).alias(f"{x}_main")) for x, c in (("x", "not asks"), ("y", "asks")))
    can = (F.col("x_total") <= F.col("y_total")) & (F.col("x_component") != F.col("y_component")) & (F.least("x_rest", "y_rest") >= share * (F.col("x_total") + F.col("y_total")))
    parts = [lighter.join(heavier.where("not y_main"), key), lighter.where("not x_main").join(heavier.where("y_main"), key)]
    return parts[0].unionByName(parts[1]).where(can).select(*paired("x_h", "y_h")).distinct()


def classes(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id) of every row of (doc_id, text): class_id is the least doc_id of its near-duplicates.

    Texts of fewer than `words` words, but one at least, are one shingle. Equal texts are of one class whatever they
    hold, empty and null ones included (null: empty); texts of blanks alone are not similar to others. Rows that repeat
    an id are one document per text. A row without an id takes the class of its near-duplicates, null if none has an id.
    Further columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(idf_weights(docs, words))
    signed = stash(signatures(docs, words, weights), "signatures")
    entries = stash(signed.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), "bands")).alias("e")).select("h", "e.id", "e.bands"), "entries")
    dealt = entries.select("h", "id", F.posexplode("bands").alias("band", "value")).select("h", "id", F.xxhash64("band", "value").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = dealt.join(shared, "bucket").distinct()
    members = stash(members.withColumn("met", F.sum("n").over(Window.partitionBy("h"))), "members")  # BANDS rows of an entry at most
    bag = stash(vectors(docs, members.select("h", "id").distinct(), words), "bags")
    label = members.select("h", F.col("h").alias("component")).distinct()
    small, large = members.where(F.col("n") <= SMALL).select("bucket", "h"), members.where(F.col("n") > SMALL).select("bucket", "h", "met")
    both = small.select("bucket", F.col("h").alias("x")).join(small.select("bucket", F.col("h").alias("y")), "bucket").where("x < y").select(*paired())
    done = None
    for k in range(LEADER_ROUNDS + 1):
        pairs = led(large, label, k) if k < LEADER_ROUNDS else prefix_pairs(large, label, bag, weights, threshold)
        pairs = pairs.unionByName(both).distinct() if k == 0 else pairs.join(done.select("u", "v"), ["u", "v"], "left_anti")
        judged = stash(verified(pairs, bag, weights, threshold), "judged")
        done = judged if done is None else done.unionByName(judged)
        label = merged(label, judged.where("linked").select("u", "v"))
    known = entries.select("h", "id").join(label, "h", "left").select("h", "id", F.coalesce("component", "h").alias("component"))
    least = known.groupBy("component").agg(F.min("id").alias("class_id"))
    known = known.join(least, "component").select("h", "class_id")
    return signed.select("doc_id", "h").join(known, "h", "left").select("doc_id", F.col("class_id").cast(docs.schema["doc_id"].dataType).alias("class_id"))


def deduplicated(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that stand for their class: those with its least id. Rows without an id stay.

    Rows that repeat an id stay if one of their texts stands for its class. Columns of any name are left as they are.
    """
    found = classes(docs, words, threshold)
    gone = found.groupBy(F.col("doc_id").alias("gone_id")).agg(F.min(F.col("class_id") != F.col("doc_id")).alias("gone")).where("gone").drop("gone")
    held = docs.select(F.struct(*docs.columns).alias("row"))
    return held.join(gone, F.col("row.doc_id") == F.col("gone_id"), "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))
